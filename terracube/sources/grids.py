"""Grids on disk: Parquet first, CSV and JSON too. One row is one cell at one time step (or one cell, for static grids)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracube.functions.transforms import no_nan


def read_grid(spark: SparkSession, path: str, variables: Sequence[str], keys: Sequence[str] = ("cell_id", "t"), fmt: str = "parquet", member: Sequence[int] | None = None, schema=None) -> DataFrame:
    """Keys and the chosen variables, in this order; NaN becomes NULL. Only these columns are read from Parquet.

    ``member`` keeps some members of an ensemble, by the column ``member``. CSV takes a ``schema``.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if member is not None:
        df = df.where(F.col("member").isin(list(member)))
    return df.select(*keys, *[no_nan(v).alias(v) if df.schema[v].dataType.typeName() in ("double", "float") else F.col(v) for v in variables])


def decode_cells(df: DataFrame, n_lon: int, cell: str = "cell_id") -> DataFrame:
    """Row and column of a flat cell number."""
    return df.withColumns({"lat_i": F.expr(f"{cell} div {int(n_lon)}").cast("int"), "lon_i": F.pmod(F.col(cell), F.lit(n_lon)).cast("int")})


def write_grid(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


COMMITS = "_commits"


def append_time_chunks(df: DataFrame, path: str, chunk: int = 200, t_i: str = "t_i", batch: str | None = None) -> None:
    """Append rows in slabs of ``chunk`` time steps, one job for all slabs; later appends extend the time axis. Read them with `read_time_chunks`.

    An append can be repeated: its rows go into directories of the slab and of its ``batch``, by default its first and last step, and replace what is there. When
    all are written, the batch's slabs are committed. What a killed append has written is read by no one, and goes when it is run again; so do slabs of an
    earlier run of the batch that this one doesn't have. Another batch name adds rows beside. Rows without a step can't be placed and raise.
    """
    spark = df.sparkSession
    if batch is None:
        lo, hi = df.agg(F.min(t_i), F.max(t_i)).first()
        batch = f"{lo}-{hi}"
    slab = F.when(F.col(t_i).isNotNull(), F.expr(f"{t_i} div {int(chunk)}")).otherwise(F.raise_error(F.lit("a row without a time step")).cast("long"))
    slabs = df.withColumns({"t_chunk": slab, "batch": F.lit(batch)})
    spread = slabs.repartition("t_chunk", F.pmod(F.xxhash64(*df.columns), F.lit(16)))
    _replace(spread, path, ("t_chunk", "batch"))
    written = spark.read.schema(slabs.schema).parquet(path).where(F.col("batch") == batch)
    kept = written.join(slabs.select("t_chunk").distinct(), "t_chunk", "left_semi")
    _replace(kept.groupBy("t_chunk").agg(F.count(F.lit(1)).alias("rows")).withColumn("batch", F.lit(batch)).coalesce(1), f"{path}/{COMMITS}", ("batch",))


def _replace(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def committed_slabs(spark: SparkSession, path: str) -> DataFrame:
    """(batch, t_chunk, rows) of the appends that ended."""
    return spark.read.schema("t_chunk long, rows long, batch string").parquet(f"{path}/{COMMITS}")


def read_time_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all appends that ended, with their slab ``t_chunk``. Directories of others are not read."""
    data = spark.read.option("basePath", path).parquet(path)
    data = data.withColumns({"t_chunk": F.col("t_chunk").cast("long"), "batch": F.col("batch").cast("string")})
    return data.join(committed_slabs(spark, path).select("batch", "t_chunk"), ["batch", "t_chunk"], "left_semi").drop("batch")


def save_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str, group_type: str | None = None) -> DataFrame:
    """Saved statistics; an error if there are none."""
    stats = spark.read.parquet(path)
    return stats if group_type is None else stats.where(F.col("group_type") == group_type)


def load_or_compute(spark: SparkSession, path: str, compute, is_train: bool, use_cached: bool = False) -> DataFrame:
    """On training data compute and save; with ``use_cached`` read what an earlier run saved, if it did. On other data always read what training saved."""
    if is_train and not (use_cached and _is_there(spark, path)):
        save_stats(compute(), path)
    return load_stats(spark, path)


def _is_there(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; any other trouble with it is raised, not taken for its absence."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def write_metric_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def label_predictions(pred: DataFrame, coords: DataFrame, keys: Sequence[str] = ("cell_id", "t_i")) -> DataFrame:
    """Flat predictions with their coordinates."""
    return coords.join(pred, list(keys), "inner")


def concat(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns meet by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
