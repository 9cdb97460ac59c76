"""Scores of predictions: maps, tables, distributions and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracube.functions import metrics as m
from terracube.operators.ordered import null_safe_join, running_sum
from terracube.sources.scratch import stash


def skill(df: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = tuple(m.METRICS), true: str = "y_true", pred: str = "y_pred", nulls: str = "drop", valid: str | None = None) -> DataFrame:
    """Every metric for every group, in one aggregation."""
    mask = F.col(valid) if valid else None
    return df.groupBy(*keys).agg(*[m.metric(name, F.col(true), F.col(pred), nulls, mask).alias(name) for name in metrics])


def metric_collection(df: DataFrame, targets: Mapping[str, tuple[str, str]], metrics: Sequence[str], keys: Sequence[str] = (), valid: Mapping[str, str] | None = None) -> DataFrame:
    """Many metrics of many targets as rows (keys, target, metric, value). Targets become rows first, so all share one pass."""
    valid = valid or {}
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.col(a).cast("double").alias("y_true"), F.col(b).cast("double").alias("y_pred"), (F.col(valid[t]) if t in valid else F.lit(True)).alias("ok")) for t, (a, b) in targets.items()])
    scores = skill(df.select(*keys, F.inline(rows)), [*keys, "target"], metrics, valid="ok")
    return scores.unpivot([*keys, "target"], list(metrics), "metric", "value")


def global_table(maps: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation (of the population) of each metric over the cells, as rows (by, metric, mean, std)."""
    long = maps.unpivot(list(by), list(metrics), "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


#: Pairs of a group that one task ranks by sorting them. Larger groups are ranked by counts.
SORTED_PAIRS = 1 << 20


def spearman(df: DataFrame, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rank correlation of each group, over pairs with both sides. A NULL key is a group like others.

    Groups of at most ``SORTED_PAIRS`` pairs move once and are sorted by either side where they are. Larger ones, and the whole table without keys, are ranked by
    counts of their distinct values, so that none is in a single task. ``df`` is read once.
    """
    keys = list(keys)
    pairs = stash(df.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).select(*keys, F.col(true).cast("double").alias("_o"), F.col(pred).cast("double").alias("_p")))
    if not keys:
        return _spearman_by_counts(pairs, keys)
    sizes = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = stash(sizes.where(F.col("_n") > SORTED_PAIRS).drop("_n"))
    if large.isEmpty():
        return _spearman_by_sorts(pairs, keys)
    few = F.broadcast(large)  # at most one row for every ``SORTED_PAIRS`` pairs
    small = _spearman_by_sorts(null_safe_join(pairs, few, keys, "left_anti"), keys)
    return small.unionByName(_spearman_by_counts(null_safe_join(pairs, few, keys, "left_semi"), keys))


def _spearman_by_sorts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A pair's rank is the middle of the first and the last place of its value."""
    for side in ("_o", "_p"):
        up = Window.partitionBy(*keys).orderBy(side)
        pairs = pairs.withColumn(f"_rank{side}", (F.rank().over(up) + F.count(F.lit(1)).over(up)) / F.lit(2.0))
    return pairs.groupBy(*keys).agg(m.pearson(F.col("_rank_o"), F.col("_rank_p")).alias("spearman"))


def _spearman_by_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks from counts of distinct values, of both sides in one table: the rows below a value within its group. Counts are summed up bucket by bucket."""
    sides = F.explode(F.array(F.struct(F.lit("_o").alias("_side"), F.col("_o").alias("_x")), F.struct(F.lit("_p").alias("_side"), F.col("_p").alias("_x")))).alias("_s")
    counts = pairs.select(*keys, sides).select(*keys, "_s.*").groupBy(*keys, "_side", "_x").agg(F.count(F.lit(1)).alias("_c"))
    below = running_sum(counts, [*keys, "_side"], "_x", F.col("_c"), "_below")
    ranks = stash(below.select(*keys, "_side", "_x", (F.col("_below") + (F.col("_c") + 1) / F.lit(2.0)).alias("_rank")))
    for side in ("_o", "_p"):
        own = ranks.where(F.col("_side") == side).select(*keys, F.col("_x").alias(side), F.col("_rank").alias(f"_rank{side}"))
        pairs = null_safe_join(pairs, own, [*keys, side])
    return pairs.groupBy(*keys).agg(m.pearson(F.col("_rank_o"), F.col("_rank_p")).alias("spearman"))


def spaef(df: DataFrame, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred", bins: int = 100, unit_range: bool = False) -> DataFrame:
    """Spatial efficiency of each slice: correlation, ratio of deviations, overlap of histograms.

    Each series is cut into ``bins`` between its own least and greatest value, so the overlap compares bins by number;
    with ``unit_range`` both are cut between 0 and 1 and other values aren't counted. A series of one value lies in the middle bin.
    """
    o, p = m.pair(F.col(true), F.col(pred))
    pairs = df.select(*keys, o.alias("o"), p.alias("p")).where("o is not null")
    stats = pairs.groupBy(*keys).agg(m.pearson(F.col("o"), F.col("p")).alias("r"), m.ratio(F.stddev_samp("p"), F.stddev_samp("o")).alias("alpha"), *[f(c).alias(f"{n}_{c}") for c in "op" for n, f in (("lo", F.min), ("hi", F.max))])

    def bin_of(c: str) -> Column:
        if unit_range:
            return F.when((F.col(c) >= 0) & (F.col(c) <= 1), F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)))
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(lo == hi, F.lit(bins // 2)).otherwise(F.least(F.floor(F.try_divide(F.col(c) - lo, hi - lo) * bins), F.lit(bins - 1)))

    both = pairs if unit_range else null_safe_join(pairs, stats.select(*keys, *[f"{n}_{c}" for c in "op" for n in ("lo", "hi")]), keys)
    long = both.select(*keys, F.explode(F.array(F.struct(F.lit("o").alias("side"), bin_of("o").alias("bin")), F.struct(F.lit("p").alias("side"), bin_of("p").alias("bin")))).alias("x")).select(*keys, "x.side", "x.bin").where("bin is not null")
    hist = long.groupBy(*keys, "bin").agg(F.count_if(F.col("side") == "o").alias("no"), F.count_if(F.col("side") == "p").alias("np"))
    totals = hist.groupBy(*keys).agg(F.sum("no").alias("to"), F.sum("np").alias("tp"), F.collect_list(F.struct("no", "np")).alias("h"))  # ``bins`` pairs of counts a group
    share = lambda n, of: F.try_divide(n.cast("double"), of.cast("double"))
    overlap = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.least(share(x["no"], F.col("to")), share(x["np"], F.col("tp"))))
    beta = totals.select(*keys, F.when((F.col("to") > 0) & (F.col("tp") > 0), overlap).alias("beta"))
    out = null_safe_join(stats, beta, keys, "left")
    sq = lambda c: (F.col(c) - 1) * (F.col(c) - 1)
    return out.select(*keys, "r", "alpha", "beta", (1 - F.sqrt(sq("r") + sq("alpha") + sq("beta"))).alias("spaef"))


def aggregate_scores(df: DataFrame, score: str, method: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, lower median, or percentile_X of the scores of slices."""
    if method == "mean":
        f = F.avg(score)
    elif method == "median":
        f = F.expr(f"percentile_disc(0.5) within group (order by {score})")
    elif method.startswith("percentile_"):
        f = F.percentile(score, float(method.split("_")[1]) / 100)
    else:
        raise ValueError(f"no method {method}")
    return df.groupBy(*keys).agg(f.alias(score))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 100) -> DataFrame:
    """Counts in ``bins`` equal bins between each column's own least and greatest value: (variable, bin, left, n)."""
    long = df.unpivot([], list(columns), "variable", "v").where("v is not null")
    ends = long.groupBy("variable").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = long.join(F.broadcast(ends), "variable").withColumn("bin", b).groupBy("variable", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # one row a variable
    return counted.select("variable", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n")


def category_quantiles(df: DataFrame, value: str, category: str = "category", t: str = "t", accuracy: int | None = None) -> DataFrame:
    """Across the cells of a category at each time: p10, p90, min, max, median.

    Exact quantiles keep a group's distinct values in memory. With ``accuracy`` they come from sketches of bounded size, each a value of the group whose
    rank is off by at most a share of 1 / accuracy: for categories with very many cells. `ordered.exact_quantiles` is exact for those, too.
    """
    at = (lambda p: F.percentile(value, p)) if accuracy is None else (lambda p: F.percentile_approx(value, p, accuracy))
    return df.groupBy(category, t).agg(at(0.1).alias("p10"), at(0.9).alias("p90"), F.min(value).alias("vmin"), F.max(value).alias("vmax"), at(0.5).alias("median"))


def monthly_climatology(df: DataFrame, value: str, cell: str = "cell_id", t: str = "t") -> DataFrame:
    """Mean of each month over all years."""
    return df.groupBy(cell, F.month(t).alias("month")).agg(F.avg(value).alias(value))


def time_mean(df: DataFrame, value: str, cell: str = "cell_id") -> DataFrame:
    return df.groupBy(cell).agg(F.avg(value).alias(value))


def weighted_score(df: DataFrame, targets: Mapping[str, tuple[str, str]], score: m.Metric, weights: Mapping[str, float] | None = None, valid: Mapping[str, str] | None = None) -> DataFrame:
    """One number for several targets: score times share of valid samples times weight (even by default), summed."""
    parts = []
    for t, (a, b) in targets.items():
        ok = F.col(valid[t]) if valid and t in valid else F.lit(True)
        w = weights[t] if weights else 1 / len(targets)
        parts.append(F.coalesce(score(F.when(ok, F.col(a)), F.when(ok, F.col(b))), F.lit(0.0)) * F.avg(ok.cast("double")) * F.lit(float(w)))
    return df.agg(sum(parts[1:], parts[0]).alias("score"))


def range_penalties(df: DataFrame, bounds: Mapping[str, tuple[float, float]], factor: float = 1.0) -> DataFrame:
    """Penalty of each parameter outside its bounds: (parameter, penalty)."""
    one = df.agg(*[m.range_penalty(F.col(p), lo, hi, factor).alias(p) for p, (lo, hi) in bounds.items()])
    return one.unpivot([], list(bounds), "parameter", "penalty")


RULES = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


def constraint_audit(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """For each rule "a op b": rows that break it, and the mean distance by which they do: (rule, broken, violation)."""
    parts = []
    for i, (a, op, b) in enumerate(rules):
        broken = ~RULES[op](F.col(a), F.col(b))
        parts += [F.count_if(broken).alias(f"n{i}"), F.coalesce(F.avg(F.when(broken, F.abs(F.col(a) - F.col(b)))), F.lit(0.0)).alias(f"v{i}")]
    rows = F.array(*[F.struct(F.lit(f"{a} {op} {b}").alias("rule"), F.col(f"n{i}").alias("broken"), F.col(f"v{i}").alias("violation")) for i, (a, op, b) in enumerate(rules)])
    return df.agg(*parts).select(F.inline(rows))


def averaged(df: DataFrame, value: str = "value", keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean of logged values, such as losses of workers or metrics of groups."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))
