"""Small helpers that the operators share: the shared folder, bounded broadcasts, skew-safe joins."""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracube.sources.scratch import new_path, shared_folder

#: A missing id counts as the largest one.
NO_ID = (1 << 63) - 1


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns that are called like ``names`` under free names, and the columns that give back all under their own."""
    clash = {n.lower() for n in names}
    moved = {c: free_name(df, c + "_") for c in df.columns if c.lower() in clash}
    return df.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in df.columns]


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage: what was computed survives a lost executor, later steps read only the
    columns they need, and values such as generated ids are fixed from then on.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(stats: DataFrame, keys: list[str], size: str, total: int, share: int = 2000) -> list[int]:
    """Hashes of the keys that hold more than ``total / share`` rows: fewer than ``share`` of them. ``stats`` has one row a key and its rows in ``size``."""
    hot = stats.where(F.col(size) * F.lit(share) > F.lit(total)).select(F.xxhash64(*keys).alias("h"))
    return [r["h"] for r in hot.collect()]


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: list[int], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` to a table with one row a key, however uneven the keys of ``rows`` are.

    Rows of the ``hot`` keys (see `hot_keys`) are spread by a hash of all their columns over ``salts`` parts, and the table's few rows of
    these keys are repeated for each part. A hash of the row, not a random number, so that a task that runs twice deals alike.
    """
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.xxhash64(*keys).isNull()  # a hash is never null
    spread = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_group_stats(rows: DataFrame, stats: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """Join ``rows`` to statistics of their groups; ``size`` is a group's number of rows, ``total`` that of all. ``keys`` must not be null."""
    return salted_join(rows, stats, keys, hot_keys(stats, keys, size, total), how)


def kept_model(spark: SparkSession, name: str, train: Callable[[], list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays of a model that is trained by rule: from a table in the shared folder if an earlier job of any session left it there, else trained and kept.

    ``name`` tells all that the model depends on: its version, seed and size. The table outlives the session; delete it to train anew.
    """
    path = f"{shared_folder(spark)}/models/{name}"
    try:
        kept = spark.read.schema("i int, a binary").parquet(path).orderBy("i").collect()  # a few arrays
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = []
    if kept:
        return [np.load(io.BytesIO(r["a"])) for r in kept]
    arrays, rows = train(), []
    for i, a in enumerate(arrays):
        np.save(to := io.BytesIO(), a)
        rows.append((i, to.getvalue()))
    spark.createDataFrame(rows, "i int, a binary").coalesce(1).write.mode("overwrite").parquet(path)
    return arrays
