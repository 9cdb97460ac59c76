"""Scaling statistics, scaling with them, and matching of distributions.

Statistics are a small table (group_type, variable, variant, center, scale), one row a variable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracube.functions import transforms as tr
from terracube.operators.ordered import null_safe_join

FITS = {
    "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
    "minmax11": lambda x: (F.min(x), F.max(x) - F.min(x)),
    "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
}


def fit(df: DataFrame, variants: Mapping[str, str], group_type: str = "dynamic") -> DataFrame:
    """Statistics of all variables in one pass, each by its own variant; missing values are skipped."""
    parts = []
    for i, (v, variant) in enumerate(variants.items()):
        center, scale = FITS[variant](F.col(v).cast("double"))
        parts += [center.alias(f"c{i}"), scale.alias(f"s{i}")]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(group_type).alias("group_type"), F.lit(v).alias("variable"), F.lit(variant).alias("variant"), F.col(f"c{i}").alias("center"), F.col(f"s{i}").alias("scale")) for i, (v, variant) in enumerate(variants.items())])
    return one.select(F.inline(rows))


def fit_minmax(df: DataFrame, variables: Sequence[str], group_type: str = "dynamic") -> DataFrame:
    return fit(df, dict.fromkeys(variables, "minmax"), group_type)


def fit_standard(df: DataFrame, variables: Sequence[str], group_type: str = "dynamic") -> DataFrame:
    return fit(df, dict.fromkeys(variables, "standard"), group_type)


def _apply(df: DataFrame, stats: DataFrame, variables: Sequence[str], how: Mapping[str, tuple], which: int) -> DataFrame:
    """One broadcast row that holds the statistics of the named variables."""
    own = stats.where(F.col("variable").isin(list(variables)))
    row = own.agg(*[F.max(F.when(F.col("variable") == v, F.struct("variant", "center", "scale"))).alias(f"_s_{v}") for v in variables])

    def new(v: str) -> Column:
        s, out = F.col(f"_s_{v}"), F.lit(None).cast("double")
        for variant, functions in how.items():
            out = F.when(s["variant"] == variant, functions[which](F.col(v), s["center"], s["scale"])).otherwise(out)
        return F.when(s.isNull(), F.col(v).cast("double")).otherwise(out)

    return df.join(F.broadcast(row)).withColumns({v: new(v) for v in variables}).drop(*[f"_s_{v}" for v in variables])


HOW = {"minmax": (tr.scaled, tr.unscaled), "standard": (tr.scaled, tr.unscaled), "bounded": (tr.scaled, tr.unscaled), "minmax11": (tr.scaled11, tr.unscaled11)}


def scale(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(x - center) / scale by each variable's variant; variables without statistics stay."""
    return _apply(df, stats, variables, HOW, 0)


def unscale(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    return _apply(df, stats, variables, HOW, 1)


def bounded_scale(df: DataFrame, bounds: Mapping[str, tuple[float, float]], variables: Sequence[str], inverse: bool = False) -> DataFrame:
    """Scaling from given bounds, without a pass over the data; a variable without bounds has center 0 and scale 1."""
    f = tr.unscaled if inverse else tr.scaled
    new = {}
    for v in variables:
        lo, hi = bounds.get(v, (0.0, 1.0))
        new[v] = f(F.col(v), F.lit(float(lo)), F.lit(float(hi) - float(lo)))
    return df.withColumns(new)


def _spread(x: Column, name: str) -> list[Column]:
    return [F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std")]


def rescale_target(df: DataFrame, target: str, bounds: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Each cell's values from their own range into the cell's [lower, upper]."""
    own = df.groupBy(cell).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    span = own.join(bounds.select(cell, "lower", "upper"), cell)
    unit = F.try_divide(F.col(target) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return df.join(span, cell).withColumn(target, unit * (F.col("upper") - F.col("lower")) + F.col("lower")).drop("_lo", "_hi", "lower", "upper")


def match_distribution(obs: DataFrame, sim: DataFrame, value: str, method: str = "zscore", cell: str = "cell_id") -> DataFrame:
    """Observed values with the mean and spread ("zscore") or the range ("minmax") that the simulation has in the same cell.

    ``sim`` holds the reference period. Both sides are summed up to one row a cell before they meet.
    """
    s = sim.groupBy(cell).agg(*_spread(F.col(value), "s"))
    o = obs.groupBy(cell).agg(*_spread(F.col(value), "o"))
    y = F.col(value)
    if method == "zscore":
        new = F.try_divide(F.col("s_std"), F.col("o_std")) * (y - F.col("o_mean")) + F.col("s_mean")
    elif method == "minmax":
        new = F.try_divide(y - F.col("o_min"), F.col("o_max") - F.col("o_min")) * (F.col("s_max") - F.col("s_min")) + F.col("s_min")
    else:
        raise ValueError(f"no method {method}")
    stats = [f"{a}_{b}" for a in "so" for b in ("min", "max", "mean", "std")]
    return obs.join(s.join(o, cell), cell).withColumn(f"{value}_matched", new).drop(*stats)


def target_mask_all(df: DataFrame, target: str, cell: str = "cell_id") -> DataFrame:
    """Cells without any target."""
    return df.groupBy(cell).agg((F.count(target) == 0).alias("mask"))


def daily(df: DataFrame, value: str, how: str = "max", cell: str = "cell_id", t: str = "t", unit: str = "day") -> DataFrame:
    """Resample in time: one value a cell and day (or other unit); units below a day keep the time of day. See `resample` for other steps."""
    start = F.date_trunc(unit, F.col(t))
    fine = unit.lower() in ("hour", "minute", "second", "millisecond", "microsecond")
    return df.groupBy(cell, (start if fine else start.cast("date")).alias(t)).agg(RESAMPLE[how](value).alias(value))


RESAMPLE = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "count": F.count}
FIXED = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 7 * 86_400}
CALENDAR = {"month": 1, "quarter": 3, "year": 12}


def resample(df: DataFrame, value: str, every: str, how: str = "mean", cell: str = "cell_id", t: str = "t", origin: str = "1970-01-01 00:00:00", fill: bool = False) -> DataFrame:
    """One value a cell and bin of time: (cell, t, value), ``t`` the bin's start as a timestamp without zone.

    ``every`` is a number and a unit: "6 hours" or "10 days" are bins of fixed width that count from ``origin``, "1 month", "2 quarters" or "1 year" are calendar
    bins that count from its month. Times before the origin lie in bins before it. ``fill`` adds each cell's missing bins between its first and last one, with
    NULL. Rows without a time are left out; a NULL cell is a cell. A bin that holds only NULL values is there, with NULL (0 for a count).
    """
    count, unit = every.split()
    count, unit = int(count), unit.lower().removesuffix("s")
    if count < 1 or unit not in {**FIXED, **CALENDAR} or how not in RESAMPLE:
        raise ValueError(f"no bins of {every} by {how}")
    at, zero = F.col(t).cast("timestamp_ntz"), F.lit(origin).cast("timestamp_ntz")
    seconds = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("second", c).cast("timestamp_ntz"))
    months = lambda c: F.year(c).cast("long") * 12 + F.month(c) - 1
    if unit in FIXED:
        bin_ = F.floor((seconds(at) - seconds(zero)) / F.lit(count * FIXED[unit]))
        start = F.timestamp_add("SECOND", F.col("_bin") * F.lit(count * FIXED[unit]), zero)
    else:
        bin_ = F.floor((months(at) - months(zero)) / F.lit(count * CALENDAR[unit]))
        start = F.timestamp_add("MONTH", (F.col("_bin") * F.lit(count * CALENDAR[unit])).cast("int"), F.date_trunc("month", zero).cast("timestamp_ntz"))
    binned = df.where(F.col(t).isNotNull()).groupBy(cell, bin_.alias("_bin")).agg(RESAMPLE[how](value).alias(value))
    if fill:
        ends = binned.groupBy(cell).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
        every_bin = ends.select(cell, F.explode(F.sequence("_lo", "_hi")).alias("_bin"))
        binned = null_safe_join(every_bin, binned, [cell, "_bin"], "left")
    return binned.select(cell, start.alias(t), value)


def target_mask_min_samples(df: DataFrame, target: str, n: int, count: str = "missing", cell: str = "cell_id", t: str = "t") -> DataFrame:
    """Cells with more than ``n`` days without a value (``count="missing"``), or fewer than ``n`` days with one ("valid")."""
    days = daily(df, target, "max", cell, t).groupBy(cell).agg(F.count_if(F.col(target).isNull()).alias("gaps"), F.count(target).alias("valid"))
    return days.select(cell, "gaps", "valid", ((F.col("gaps") > n) if count == "missing" else (F.col("valid") < n)).alias("mask"))
