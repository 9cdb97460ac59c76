"""Moments of pairs as states that can be merged: a pass over the rows of one slab of time, then all levels (cells, categories, the globe) from small tables.

A state is one row: n, means, sums of squared deviations and of their product, ends, and the sum of the truth's absolute values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracube.functions.metrics import pair, ratio
from terracube.operators.ordered import null_safe_join

STATE = ("n", "mean_o", "mean_p", "m2_o", "m2_p", "c_op", "abs_o", "min_o", "max_o", "min_p", "max_p")


def moments(df: DataFrame, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """The state of each group, over pairs with both sides. Rows are summed up where they are read; a group without pairs has n = 0 and NULLs."""
    o, p = pair(F.col(true).cast("double"), F.col(pred).cast("double"))
    n = F.count(o)
    parts = [n, F.avg(o), F.avg(p), F.var_pop(o) * n, F.var_pop(p) * n, F.covar_pop(o, p) * n, F.sum(F.abs(o)), F.min(o), F.max(o), F.min(p), F.max(p)]
    return df.groupBy(*keys).agg(*[c.alias(name) for c, name in zip(parts, STATE, strict=True)])


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The states of coarser groups: what a pass over all their rows would give.

    A group's mean comes first; then each state adds its own squared deviations and those of its mean, so that no large numbers cancel. NULL keys are groups.
    """
    keys = list(keys)
    n = F.col("n").cast("double")
    mean = lambda c: F.sum(n * F.col(c)) / F.sum(F.when(F.col("n") > 0, n))
    center = states.groupBy(*keys).agg(*[mean(f"mean_{x}").alias(f"_{x}") for x in "op"])
    away = null_safe_join(states, center, keys) if keys else states.join(F.broadcast(center))  # one row without keys
    do, dp = F.col("mean_o") - F.col("_o"), F.col("mean_p") - F.col("_p")
    parts = [
        F.sum("n"), F.first("_o", ignorenulls=True), F.first("_p", ignorenulls=True), F.sum(F.col("m2_o") + n * do * do), F.sum(F.col("m2_p") + n * dp * dp), F.sum(F.col("c_op") + n * do * dp),
        F.sum("abs_o"), F.min("min_o"), F.max("max_o"), F.min("min_p"), F.max("max_p"),
    ]
    return away.groupBy(*keys).agg(*[c.alias(name) for c, name in zip(parts, STATE, strict=True)])


def _scores() -> dict[str, Column]:
    n, mo, mp, vo, vp, c = (F.col(x) for x in STATE[:6])
    mse = ratio(vo + vp - 2 * c, n) + (mp - mo) * (mp - mo)
    mse = F.when(mse < 0, F.lit(0.0)).otherwise(mse)  # rounding
    r, beta = ratio(c, F.sqrt(vo) * F.sqrt(vp)), ratio(mp, mo)
    alpha = ratio(F.sqrt(ratio(vp, n - 1)), F.sqrt(ratio(vo, n - 1)))
    kge = 1 - F.sqrt((r - 1) * (r - 1) + (alpha - 1) * (alpha - 1) + (beta - 1) * (beta - 1))
    away = ratio(vo, n) + (mo - mp) * (mo - mp)
    gamma = ratio(ratio(F.sqrt(ratio(vp, n)), mp), ratio(F.sqrt(ratio(vo, n)), mo))
    return {"mse": mse, "rmse": F.sqrt(mse), "bias": mp - mo, "pbias": ratio(100 * (mp - mo) * n, F.col("abs_o")), "pearson": r, "nse": 1 - ratio(mse, away), "kge": kge, "gamma": gamma, "nrmse": ratio(F.sqrt(mse), mp)}


def scores(states: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The metrics of each state, by the formulas of `terracube.functions.metrics`; NULL where they aren't defined."""
    formulas = _scores()
    return states.select(*keep, *[formulas[name].alias(name) for name in metrics])


def statistics(states: DataFrame, variant: str, side: str = "o") -> DataFrame:
    """(center, scale) of one side, as `stats.fit` gives them: "minmax" or "standard"."""
    lo, hi = F.col(f"min_{side}"), F.col(f"max_{side}")
    both = {"minmax": (lo, hi - lo), "standard": (F.col(f"mean_{side}"), F.sqrt(ratio(F.col(f"m2_{side}"), F.col("n"))))}[variant]
    own = [c for c in states.columns if c not in STATE]
    return states.select(*own, both[0].alias("center"), both[1].alias("scale"))


def levels(states: DataFrame, groups: dict[str, Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """Scores at several levels from one table of states: (level, key, n, metrics). ``groups`` names each level's columns; their values make the key, joined by "/"."""
    out = None
    for level, keys in groups.items():
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]) if keys else F.lit("all")
        own = scores(merge(states, keys).withColumns({"level": F.lit(level), "key": key}), metrics, ["level", "key", "n"])
        out = own if out is None else out.unionByName(own)
    return out


def update(df: DataFrame, path: str, slab: str, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred") -> None:
    """Put the states of one slab of time into a table of slabs. Only the slab's rows are read; running it again replaces the slab."""
    states = moments(df, keys, true, pred).withColumn("slab", F.lit(slab))
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All slabs' states; an error that names the path if there are none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no states in {path}") from e
