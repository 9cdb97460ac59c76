"""Work along an order (running sums, quantiles, nearest values, steps) without a task that holds a whole group.

Numbers are told apart by the bits of their doubles, made to sort like the numbers. The first bits cut any column into buckets that are constants of the
data: the same in every task and at every repetition, and no job has to look for cuts while the plan is built. Inside a bucket rows are sorted; what a bucket
hands on to later ones comes from a table with one row a bucket. Groups may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracube.sources.scratch import stash

#: Sign, exponent and 8 bits of the mantissa: 256 buckets between a power of two and the next.
BUCKET_BITS = 20
#: Quantiles settle so many bits in a round; a round counts at most 2^22 buckets for a group and rank.
ROUND_BITS = 22


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL."""
    other = b.withColumnsRenamed({k: f"_{k}_of_b" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}_of_b")) for k in keys], F.lit(True))
    out = a.join(other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_{k}_of_b" for k in keys])


def number(df: DataFrame, column: str) -> Column:
    """A number, day or time as a double that sorts alike."""
    kind = df.schema[column].dataType.typeName()
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.unix_micros(column).cast("double") if kind == "timestamp" else F.col(column).cast("double")


def order_bits(x: Column) -> Column:
    """A long that sorts like the double, negative zero with zero; NULL stays."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(x.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1))))


def from_bits(bits: Column) -> Column:
    plain = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.when(bits.isNotNull(), F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), plain).cast("double"))


def bucketed(df: DataFrame, order: str, name: str = "_bucket") -> DataFrame:
    """``df`` in the shared folder, with the bucket of each row: computed once, whatever reads it how often."""
    return stash(df.withColumn(name, F.shiftright(order_bits(number(df, order)), 64 - BUCKET_BITS)))


def running_sum(df: DataFrame, groups: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """A column ``name``: the sum of ``value`` over the earlier rows of the group, in the order of a column of numbers, days or times without ties."""
    groups = list(groups)
    rows = bucketed(df.withColumn("_v", value), order)
    before = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_inner", F.coalesce(F.sum("_v").over(before), F.lit(0)))
    sums = rows.groupBy(*groups, "_bucket").agg(F.sum("_v").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # buckets of a group, not its rows
    firsts = sums.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return null_safe_join(inner, firsts, [*groups, "_bucket"]).withColumn(name, F.col("_first") + F.col("_inner")).drop("_bucket", "_v", "_inner", "_first")


def with_previous(df: DataFrame, groups: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Columns ``previous_<c>`` and ``has_previous``: the row before within the group, in the order of a column without ties."""
    groups = list(groups)
    rows = bucketed(df, order)
    row = F.struct(F.lit(True).alias("ok"), *columns)
    inner = rows.withColumn("_p", F.lag(row).over(Window.partitionBy(*groups, "_bucket").orderBy(order)))
    lasts = rows.groupBy(*groups, "_bucket").agg(F.max_by(row, order).alias("_last"))
    earlier = lasts.select(*groups, "_bucket", F.lag("_last").over(Window.partitionBy(*groups).orderBy("_bucket")).alias("_carried"))  # buckets of a group
    out = null_safe_join(inner, earlier, [*groups, "_bucket"]).withColumn("_p", F.coalesce("_p", "_carried"))
    return out.withColumns({f"previous_{c}": F.col(f"_p.{c}") for c in columns}).withColumn("has_previous", F.coalesce("_p.ok", F.lit(False))).drop("_p", "_carried", "_bucket")


def monotonicity(df: DataFrame, groups: Sequence[str], t: str, x: str, y: str) -> DataFrame:
    """Does y rise where x does? For each group, along ``t``: (groups, steps, broken, penalty).

    ``steps`` counts steps of time with both values at both ends at which x doesn't fall, ``broken`` those of them at which y falls; ``penalty`` is the sum of the
    squares of these falls over ``steps``, NULL without steps. A group may hold any share of all rows: steps between buckets take the last row of the bucket before.
    """
    rows = with_previous(df.select(*groups, t, x, y), groups, t, [x, y])
    dx, dy = F.col(x) - F.col(f"previous_{x}"), F.col(y) - F.col(f"previous_{y}")
    fall = F.when((dx >= 0) & dy.isNotNull(), F.greatest(-dy, F.lit(0.0)))
    return rows.groupBy(*groups).agg(F.count(fall).alias("steps"), F.count_if(fall > 0).alias("broken"), F.avg(fall * fall).alias("penalty"))


# -- exact quantiles ---------------------------------------------------------------------------


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """The quantiles (linear between neighbours) of all groups: (keys, p, quantile). NULL and NaN are left out; a group without values has no rows.

    The two ranks around each quantile are found by three rounds of counts. A round counts the next 22 bits of the values that still share a rank's bits so far,
    and takes the bits at which the counts reach the rank. No group's values are ever gathered or sorted; a task sorts at most 2^22 counts of a group and rank.
    """
    keys = list(keys)
    x = number(df, value)
    rows = stash(df.select(*keys, order_bits(x).alias("_bits")).where(x.isNotNull() & ~F.isnan(x)))
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spot = sizes.select(*keys, F.explode(ps).alias("p"), "_n").withColumn("_at", F.col("p") * (F.col("_n") - 1))
    ends = spot.select(*keys, "p", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
    left = ends.select(*keys, "_rank", F.col("_rank").alias("_left"), F.lit(0).cast("long").alias("_prefix")).distinct()
    before = 64
    while before > 0:
        shift = max(0, before - ROUND_BITS)
        open_ = rows.withColumns({"_prefix": F.shiftright("_bits", before) if before < 64 else F.lit(0).cast("long"), "_digit": F.shiftright("_bits", shift)})
        before = shift
        wanted = left.select(*keys, "_prefix").distinct()
        counts = null_safe_join(open_, wanted, [*keys, "_prefix"], "left_semi").groupBy(*keys, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_c"))
        own = Window.partitionBy(*keys, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^22 counts
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(own), F.lit(0)))
        met = null_safe_join(left, counts, [*keys, "_prefix"]).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_c")))
        left = met.select(*keys, "_rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_digit").alias("_prefix"))
        left = stash(left)  # one row a group and rank
    values = left.select(*keys, "_rank", from_bits(F.col("_prefix")).alias("_x"))
    both = null_safe_join(ends, values, [*keys, "_rank"]).groupBy(*keys, "p", "_at").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    return both.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))


# -- nearest values ----------------------------------------------------------------------------


def nearest_on_axis(values: DataFrame, axis: DataFrame, value: str, at: str, name: str = "nearest") -> DataFrame:
    """Each distinct value of ``values.value`` with the nearest value of ``axis.at``, at any spacing and any distance: (value, name, distance). Of two that are as
    near the smaller one is taken. Values that are NULL or NaN are left out; without an axis value all get NULL.

    Both tables are sorted together, bucket by bucket; the last axis value before a bucket and the first one after it come from a table of buckets.
    """
    sound = lambda df, c: df.select(F.col(c).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).distinct()
    marked = sound(values, value).withColumn("_axis", F.lit(False)).unionByName(sound(axis, at).withColumn("_axis", F.lit(True)))
    rows = bucketed(marked.groupBy("_x").agg(F.bool_or("_axis").alias("_axis"), F.bool_or(~F.col("_axis")).alias("_asked")), "_x")
    mark = F.when(F.col("_axis"), F.col("_x"))
    up = Window.partitionBy("_bucket").orderBy("_x")
    inner = rows.withColumns({"_lo": F.last(mark, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), "_hi": F.first(mark, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))})
    ends = rows.groupBy("_bucket").agg(F.min(mark).alias("_first"), F.max(mark).alias("_last"))
    over = Window.orderBy("_bucket")  # one row a bucket of 256 between powers of two, whatever the number of values
    ends = ends.select("_bucket", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    both = inner.where("_asked").join(ends, "_bucket").select("_x", F.coalesce("_lo", "_before").alias("_lo"), F.coalesce("_hi", "_after").alias("_hi"))
    down, upper = F.col("_x") - F.col("_lo"), F.col("_hi") - F.col("_x")
    near = F.when(upper.isNull() | (down <= upper), F.col("_lo")).otherwise(F.col("_hi"))
    return both.select(F.col("_x").alias(value), near.alias(name), F.abs(F.col("_x") - near).alias("distance"))


def nearest_on_axes(points: DataFrame, cells: DataFrame, axes: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Each point with the cell at the nearest latitude and the nearest longitude of the grid's own axes, which need not be regular: all columns of both, those of
    the cell's axes as ``cell_<axis>`` and the cell's columns that a point has too left out. Every point with coordinates gets an answer: NULL cells where the grid
    has a hole there (see `nearest_existing`), or where a coordinate is NULL."""
    out = points
    for a in axes:
        found = nearest_on_axis(points, cells, a, a, f"cell_{a}").drop("distance")
        keyed = found.withColumnRenamed(a, "_at")
        out = out.join(keyed, out[a].cast("double") == keyed["_at"], "left").drop("_at")
    own = cells.select(*[F.col(a).cast("double").alias(f"cell_{a}") for a in axes], *[c for c in cells.columns if c not in {*axes, *points.columns}])
    return out.join(own, [f"cell_{a}" for a in axes], "left")


#: Children of a square along each axis, and axis values in a square of the last level.
FANOUT, LEAF = 8, 8


def nearest_existing(points: DataFrame, cells: DataFrame, id_col: str, cell: str = "cell_id", axes: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """The nearest cell that exists, by Euclidean distance in the units of the axes, ties to the smaller cell: (id_col, axes, cell, distance). One row for each
    distinct id and place; points without coordinates have none; without a cell there are no rows.

    Branch and bound down a tree of squares. Squares are cut by the places of coordinates among the distinct ones, 8 x 8 to a square, so that uneven axes fill
    them evenly; each has the bounds of its cells. Level by level a point keeps the squares whose nearest corner is no farther than the least far corner of any of
    its squares, and it meets the cells of what it keeps at the last level. Holes and points far outside cost no more than others.
    """
    a, b = axes
    sound = "_a is not null and _b is not null and not isnan(_a) and not isnan(_b)"
    real = lambda df, c: df.select(c, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).where(sound)
    there = stash(real(cells, cell).groupBy("_a", "_b").agg(F.min(cell).alias(cell)).withColumnsRenamed({"_a": "_ca", "_b": "_cb"}))
    for c, place in (("_ca", "_i"), ("_cb", "_j")):
        ranks = running_sum(there.select(c).distinct(), [], c, F.lit(1), place)
        there = there.join(ranks, c)
    there = stash(there)
    most = there.agg(F.greatest(F.max("_i"), F.max("_j"))).first()[0] or 0
    depth = 1
    while LEAF * FANOUT**depth <= most:
        depth += 1
    gap = lambda x, lo, hi: F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0))
    far = lambda x, lo, hi: F.greatest(F.abs(F.col(x) - F.col(lo)), F.abs(F.col(x) - F.col(hi)))
    length = lambda u, v: F.sqrt(u * u + v * v)
    state = real(points, id_col).distinct().withColumns({"_si": F.lit(0).cast("long"), "_sj": F.lit(0).cast("long")})
    own = Window.partitionBy(id_col, "_a", "_b")
    for level in range(1, depth + 1):
        side = LEAF * FANOUT ** (depth - level)
        square = lambda c, side=side: F.floor(F.col(c) / F.lit(side))
        boxes = there.groupBy(square("_i").alias("_ni"), square("_j").alias("_nj")).agg(F.min("_ca").alias("_a0"), F.max("_ca").alias("_a1"), F.min("_cb").alias("_b0"), F.max("_cb").alias("_b1"))
        boxes = boxes.withColumns({"_si": F.floor(F.col("_ni") / F.lit(FANOUT)), "_sj": F.floor(F.col("_nj") / F.lit(FANOUT))})
        if level <= 2:  # 4,096 squares at most
            boxes = F.broadcast(boxes)
        met = state.join(boxes, ["_si", "_sj"])
        met = met.withColumns({"_near": length(gap("_a", "_a0", "_a1"), gap("_b", "_b0", "_b1")), "_far": length(far("_a", "_a0", "_a1"), far("_b", "_b0", "_b1"))})
        met = met.withColumn("_bound", F.min("_far").over(own)).where(F.col("_near") <= F.col("_bound") * (1 + 1e-12))
        state = met.select(id_col, "_a", "_b", F.col("_ni").alias("_si"), F.col("_nj").alias("_sj"))
    leaves = there.withColumns({"_si": F.floor(F.col("_i") / F.lit(LEAF)), "_sj": F.floor(F.col("_j") / F.lit(LEAF))}).drop("_i", "_j")
    met = state.join(leaves, ["_si", "_sj"])
    best = F.min(F.struct(length(F.col("_a") - F.col("_ca"), F.col("_b") - F.col("_cb")).alias("distance"), F.col(cell))).alias("_best")
    found = met.groupBy(id_col, "_a", "_b").agg(best)
    return found.select(id_col, F.col("_a").alias(a), F.col("_b").alias(b), f"_best.{cell}", "_best.distance")
