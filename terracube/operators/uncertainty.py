"""Ensembles and conformal prediction intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracube.operators.ordered import exact_quantiles


def ensemble_spread(df: DataFrame, value: str, keys: Sequence[str] = ("cell_id", "t")) -> DataFrame:
    """Mean and sample deviation over the members."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def conformal_scores(df: DataFrame, true: str = "y_true", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """How far the truth lies outside its interval (below 0: inside)."""
    return df.withColumn("score", F.greatest(F.col(true) - F.col(upper), F.col(lower) - F.col(true)))


def conformal_q(calibration: DataFrame, coverages: Sequence[float], exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """For each coverage the linear quantile of the scores: (coverage, q).

    ``exact`` finds the two neighbours of each quantile by rounds of counts (`ordered.exact_quantiles`), so that no task holds or sorts all scores; otherwise a
    sketch of bounded size.
    """
    scores = conformal_scores(calibration).where(F.col("score").isNotNull()).select("score")
    if not exact:
        one = scores.agg(F.percentile_approx("score", [float(c) for c in coverages], accuracy).alias("q"))
        return one.select(F.inline(F.arrays_zip(F.array(*[F.lit(float(c)) for c in coverages]).alias("coverage"), F.col("q"))))
    return exact_quantiles(scores, [], "score", coverages).select(F.col("p").alias("coverage"), F.col("quantile").alias("q"))


def conformal_intervals(test: DataFrame, q: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Intervals widened by q and their midpoints, a row for each coverage."""
    both = test.join(F.broadcast(q))  # one row a coverage
    both = both.withColumns({"interval_lower": F.col(lower) - F.col("q"), "interval_upper": F.col(upper) + F.col("q")})
    return both.withColumn("midpoint", (F.col("interval_lower") + F.col("interval_upper")) / F.lit(2.0))


def empirical_coverage(intervals: DataFrame, true: str = "y_true", count_null_as_miss: bool = False) -> DataFrame:
    """Percentage of truths inside their interval."""
    inside = ((F.col(true) >= F.col("interval_lower")) & (F.col(true) <= F.col("interval_upper"))).cast("double")
    if count_null_as_miss:
        inside = F.coalesce(inside, F.lit(0.0))
    return intervals.groupBy("coverage").agg((F.avg(inside) * 100).alias("empirical_coverage"))
