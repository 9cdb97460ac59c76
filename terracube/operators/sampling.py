"""Sampling that depends on (seed, key) alone: the same rows at any partitioning, in any order.

Samples are drawn on the tables of distinct cells or times, never on the rows of a grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracube.operators.ordered import null_safe_join, running_sum
from terracube.sources.scratch import stash

PRIME = 2147483647


def seeded_hash(key: Column, seed: int | Column = 0) -> Column:
    """A number below 2^31 - 1 from a whole key below 10^14, in integer arithmetic that any SQL engine repeats."""
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    h = (key.cast("long") + seed * 7919) * 48271 % PRIME
    return h * (h + 12345) % PRIME


def _first(keys: DataFrame, key: str, n: Column | int, seed: int, groups: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(seeded_hash(F.col(key), seed), key)
    return keys.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def sample_keys(df: DataFrame, key: str, fraction: float | None = None, count: int | None = None, seed: int = 0) -> DataFrame:
    """Exactly int(n * fraction), or ``count``, of the n distinct keys, without replacement.

    The smallest hashes win. Keys are counted by steps of their hash (4,096 at most); a table of the steps tells how many keys lie before each, and keys are
    numbered within their step, so that no task sorts all keys. No job runs while the plan is built.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_step", F.shiftright(seeded_hash(F.col(key), seed), 19))
    steps = keys.groupBy("_step").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy())
    size = F.floor(total * F.lit(float(fraction)) + F.lit(1e-9)) if count is None else F.lit(count)
    taken = steps.select("_step", before.alias("_before"), size.alias("_size")).where("_before < _size")
    own = Window.partitionBy("_step").orderBy(seeded_hash(F.col(key), seed), key)
    placed = keys.join(F.broadcast(taken), "_step").withColumn("_place", F.row_number().over(own))
    return placed.where(F.col("_before") + F.col("_place") <= F.col("_size")).select(key)


def downsample(df: DataFrame, cell: str | None = "cell_id", t_i: str | None = "t_i", cell_fraction: float = 1.0, time_fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows of a random share of the cells and of the time steps. ``df`` is read once for each key and once more: best from a table on disk."""
    for key, fraction in ((cell, cell_fraction), (t_i, time_fraction)):
        if key is not None and fraction < 1:
            df = df.join(sample_keys(df, key, fraction, seed=seed), key, "left_semi")
    return df


def regular_interval(cells: DataFrame, interval: int, origin: int = 0) -> DataFrame:
    """Every ``interval``-th row and column, from ``origin``."""
    on = lambda c: (F.col(c) >= origin) & (F.pmod(F.col(c) - origin, F.lit(interval)) == 0)
    return cells.where(on("lat_i") & on("lon_i"))


def sample_cubelets(catalogue: DataFrame, space_fraction: float, time_fraction: float, seed: int = 0) -> DataFrame:
    """Blocks whose spatial and temporal numbers both are in a random share of those that exist."""
    space, time = sample_keys(catalogue, "s_idx", space_fraction, seed=seed), sample_keys(catalogue, "k_idx", time_fraction, seed=seed + 1)
    return catalogue.join(space, "s_idx", "left_semi").join(time, "k_idx", "left_semi")


def with_replacement(df: DataFrame, fraction: float, key: str, group: str | None = None, seed: int = 0) -> DataFrame:
    """int(n * fraction) draws with replacement from each group (or from all rows), numbered by ``draw``.

    Draw i of a group takes the row at position hash(i, group) modulo n, in the order of ``key``. Positions are counted bucket by bucket, so that no task sorts a
    whole group. A NULL group is one like others and counts as -1 in the hash; rows without a key can't be drawn. ``df`` is read once.
    """
    groups = [group] if group else []
    ranked = stash(running_sum(df.where(F.col(key).isNotNull()), groups, key, F.lit(1), "_pos"))
    sizes = ranked.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("_k", F.floor(F.col("_n") * F.lit(fraction) + F.lit(1e-9)).cast("long")).where("_k > 0")
    draws = draws.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
    spot = F.pmod(seeded_hash(F.col("draw") + (F.coalesce(F.col(group).cast("long"), F.lit(-1)) * 100003 if group else F.lit(0)), seed), F.col("_n"))
    draws = draws.select(*groups, "draw", spot.alias("_pos"))
    return null_safe_join(draws, ranked, [*groups, "_pos"]).drop("_pos")


def epoch_starts(n_times: int, length: int, spark, epochs: int = 1, fraction: float | None = None, count: int | None = None, seed: int = 0, replace: bool = False) -> DataFrame:
    """For each epoch a random set of first steps, shared by all cells: (epoch, t0).

    ``fraction`` takes int((T - L) * fraction) of them; ``count`` takes that many, or all if there aren't more.
    """
    n = max(0, n_times - length)
    size = int(n * fraction + 1e-9) if count is None else (count if n - count > 0 else n)
    base = spark.range(epochs).withColumnRenamed("id", "epoch")
    if replace:
        drawn = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(size)))) if size else base.withColumn("draw", F.lit(1)).where("false")
        return drawn.select("epoch", "draw", F.pmod(seeded_hash(F.col("draw") + F.col("epoch") * 100003, seed), F.lit(max(1, n))).alias("t0"))
    starts = base.withColumn("t0", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else base.withColumn("t0", F.lit(0)).where("false")
    order = Window.partitionBy("epoch").orderBy(seeded_hash(F.col("t0") + F.col("epoch") * 100003, seed), "t0")
    return starts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def epoch_order(samples: DataFrame, key: str, epoch: int = 0, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """Samples in a random or in their own order; a range-partitioned sort."""
    return samples.orderBy(seeded_hash(F.col(key) + epoch * 100003, seed), key) if shuffle else samples.orderBy(key)


def shard(samples: DataFrame, index: str, rank: int, n: int) -> DataFrame:
    """The share of one of ``n`` workers."""
    return samples.where(F.pmod(F.col(index), F.lit(n)) == rank)


def points_per_category(cells: DataFrame, category: str, k: int, key: str = "cell_id", seed: int = 0) -> DataFrame:
    """``k`` random cells of each category, all if it has fewer."""
    return _first(cells, key, k, seed, [category])
