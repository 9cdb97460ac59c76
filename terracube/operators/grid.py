"""Selecting, masking, aligning and reshaping grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracube.sources.scratch import stash


# -- selection ---------------------------------------------------------------------------------


def select_variables(df: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("cell_id", "t")) -> DataFrame:
    return df.select(*keys, *variables)


def time_range(df: DataFrame, lo: str, hi: str, t: str = "t") -> DataFrame:
    """Rows from ``lo`` to the whole day ``hi``; the predicate reaches the scan."""
    end = F.date_add(F.to_date(F.lit(hi)), 1).cast(df.schema[t].dataType)
    return df.where((F.col(t) >= F.lit(lo).cast(df.schema[t].dataType)) & (F.col(t) < end))


def split_periods(df: DataFrame, periods: Mapping[str, tuple[str, str]], t: str = "t") -> DataFrame:
    """A column ``period``; a row in several ranges appears once for each, a row in none is left out."""
    kind = df.schema[t].dataType
    inside = [F.when((F.col(t) >= F.lit(lo).cast(kind)) & (F.col(t) < F.date_add(F.to_date(F.lit(hi)), 1).cast(kind)), F.lit(name)) for name, (lo, hi) in periods.items()]
    return df.withColumn("period", F.explode(F.array_compact(F.array(*inside))))


def select_members(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def extent(cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Bounds with half a cell around, and the resolution of both axes."""
    res = {a: F.try_divide(F.max(a) - F.min(a), F.count_distinct(a) - 1) for a in (lat, lon)}
    sides = cells.agg(*[f(a).alias(f"{n}_{a}") for a in (lat, lon) for n, f in (("min", F.min), ("max", F.max))], *[res[a].alias(f"res_{a}") for a in (lat, lon)])
    half = {a: F.coalesce(F.col(f"res_{a}"), F.lit(0.0)) / F.lit(2.0) for a in (lat, lon)}
    return sides.select(*[(F.col(f"min_{a}") - half[a]).alias(f"min_{a}") for a in (lat, lon)], *[(F.col(f"max_{a}") + half[a]).alias(f"max_{a}") for a in (lat, lon)], f"res_{lat}", f"res_{lon}")


# -- masks and missing values ------------------------------------------------------------------


def combine_masks(df: DataFrame, layers: Sequence[str], name: str = "mask") -> DataFrame:
    """True where any layer is; a missing layer counts as not masked."""
    return df.withColumn(name, reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit(False)) for c in layers)))


def combine_mask_rows(df: DataFrame, cell: str = "cell_id", mask: str = "mask") -> DataFrame:
    """The same for one row a cell and layer; the layers of a cell are combined before they move."""
    return df.groupBy(cell).agg(F.coalesce(F.bool_or(mask), F.lit(False)).alias(mask))


def valid_cells(static: DataFrame, mask: str = "mask", keep_all: bool = False) -> DataFrame:
    """Cells outside the mask; ``keep_all`` for a test period."""
    return static if keep_all else static.where(~F.col(mask))


def drop_cells(df: DataFrame, cells: DataFrame, on: str = "cell_id") -> DataFrame:
    return df.join(cells.select(on).distinct(), on, "left_anti")


def mask_values(df: DataFrame, masks: DataFrame, columns: Sequence[str], on: str = "cell_id", mask: str = "mask") -> DataFrame:
    """NULL in masked cells; rows stay."""
    joined = df.join(masks.select(on, F.col(mask).alias("_m")), on, "left")
    return joined.withColumns({c: F.when(~F.coalesce(F.col("_m"), F.lit(False)), F.col(c)) for c in columns}).drop("_m")


def fill_missing(df: DataFrame, value: float, columns: Sequence[str]) -> DataFrame:
    return df.fillna(value, list(columns))


def keep_valid(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def missing_cells(df: DataFrame, features: Sequence[str], name: str = "missing") -> DataFrame:
    """True where any feature is missing."""
    return df.withColumn(name, reduce(lambda a, b: a | b, (F.col(c).isNull() for c in features)))


def reconstruct_missing(result: DataFrame, cells: DataFrame, on: Sequence[str] = ("cell_id",)) -> DataFrame:
    """A row for every cell; NULL where the result has none."""
    return cells.select(*on).join(result, list(on), "left")


def complete_grid(df: DataFrame, cells: DataFrame, times: DataFrame, cell: str = "cell_id", t: str = "t") -> DataFrame:
    """A row for every cell and time. Times are one axis of the grid, a short list beside its rows, and go to the cells as one array."""
    axis = times.agg(F.collect_set(t).alias("_axis"))
    every = cells.select(cell).distinct().join(F.broadcast(axis)).select(cell, F.explode("_axis").alias(t))
    return every.join(df, [cell, t], "left")


# -- indexing ----------------------------------------------------------------------------------


def grid_index(lat_i: Column, lon_i: Column, n_lon: int) -> Column:
    """Row-major number of a cell."""
    return (lat_i * n_lon + lon_i).cast("long")


def dense_index(keys: DataFrame, key: str, name: str, parts: int | None = None) -> DataFrame:
    """0, 1, 2, ... in the order of distinct keys, without one task that sorts them all.

    Keys are sorted into ranges; a small table of the ranges' counts gives each range its first number. The ranges come from a sample of the keys, so they are
    written to the shared folder before they are counted: both steps see the same ones, even if a task runs again.
    """
    parts = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id())
    inner = stash(ranged).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sizes = inner.groupBy("_p").agg(F.max("_r").alias("_n"))
    sizes = sizes.select(F.col("_p").alias("_q"), (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_first"))
    return inner.join(F.broadcast(sizes), F.col("_p") == F.col("_q")).select(key, (F.col("_first") + F.col("_r") - 1).cast("long").alias(name))  # one row for each of ``parts`` ranges


def cell_linear_index(cells: DataFrame, mask: str = "mask", cell: str = "cell_id") -> DataFrame:
    """Number of each valid cell in row-major order."""
    return dense_index(cells.where(~F.col(mask)), cell, "cell_index", 32)


def time_index(df: DataFrame, t: str = "t") -> DataFrame:
    """Number of each time step. The distinct steps are one axis of the grid, a short list that one task numbers."""
    return df.select(t).where(F.col(t).isNotNull()).distinct().select(t, (F.row_number().over(Window.orderBy(t)) - 1).cast("long").alias("t_i"))


def spacetime_index(cells: DataFrame, n_times: int, length: int, include_last: bool = False) -> DataFrame:
    """Every cell with every first step of a sequence of ``length`` steps."""
    last = n_times - length - (0 if include_last else 1)
    starts = F.sequence(F.lit(0), F.lit(last)) if last >= 0 else F.array().cast("array<int>")
    return cells.select("cell_index", F.explode(starts).alias("t0"))


def flat_time_ids(index: DataFrame, n_times: int, cell: str = "cell_index", t: str = "t0") -> DataFrame:
    """Row number of (cell, step) in a cube flattened cell by cell."""
    return index.withColumn("flat_id", (F.col(t) + F.col(cell) * n_times).cast("long"))


# -- reshaping ---------------------------------------------------------------------------------


def stack_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("cell_id", "t")) -> DataFrame:
    """Wide to long: (keys, feat, v)."""
    return df.unpivot(list(keys), list(features), "feat", "v")


def spread_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("cell_id", "t")) -> DataFrame:
    """Long to wide, for a known list of features."""
    return df.groupBy(*keys).pivot("feat", list(features)).agg(F.first("v", ignorenulls=True))


def feature_vectors(df: DataFrame, features: Sequence[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in features]))


def static_to_dynamic(dynamic: DataFrame, static: DataFrame, on: str = "cell_id", dynamic_vec: str = "xd", static_vec: str = "xs") -> DataFrame:
    """Each row's dynamic features followed by its cell's static ones."""
    return dynamic.join(static.select(on, static_vec), on).withColumn("x", F.concat(dynamic_vec, static_vec))


# -- joins -------------------------------------------------------------------------------------


def align(true: DataFrame, pred: DataFrame, on: Sequence[str] = ("cell_id", "t")) -> DataFrame:
    """Truth and prediction where both exist."""
    return true.join(pred, list(on), "inner")


def on_times_of(df: DataFrame, other: DataFrame, t: str = "t") -> DataFrame:
    """Rows at the times that the other table has."""
    return df.join(other.select(t).distinct(), t, "left_semi")


def merge_columns(parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """All columns of all parts; rows that any part has."""
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), parts)


def half_cell_join(fine: DataFrame, coarse: DataFrame, res: float, lat0: float, lon0: float) -> DataFrame:
    """Finer cells within half a coarse cell of its centre: an equality of integers, not a range condition.

    ``coarse`` has (cell, lat, lon) at lat0 + i * res; a finer cell belongs to the coarse cell whose number is
    floor((lat - lat0) / res + 0.5), so one on the border goes to the upper cell.
    """
    at = lambda x, x0: F.floor((x - x0) / F.lit(res) + 0.5)
    f = fine.withColumns({"_i": at(F.col("lat"), lat0), "_j": at(F.col("lon"), lon0)})
    c = coarse.select(F.col("cell_id").alias("coarse_id"), at(F.col("lat"), lat0).alias("_i"), at(F.col("lon"), lon0).alias("_j"))
    return f.join(c, ["_i", "_j"]).drop("_i", "_j")


def nearest_cell(points: DataFrame, cells: DataFrame, res: float, lat0: float, lon0: float) -> DataFrame:
    """The cell of a regular grid nearest to each point; points more than half a cell outside get no row. For uneven axes, holes and points far outside see
    `ordered.nearest_on_axes` and `ordered.nearest_existing`."""
    at = lambda x, x0: F.floor((x - x0) / F.lit(res) + 0.5)
    c = cells.select("cell_id", at(F.col("lat"), lat0).alias("_i"), at(F.col("lon"), lon0).alias("_j"))
    return points.withColumns({"_i": at(F.col("lat"), lat0), "_j": at(F.col("lon"), lon0)}).join(c, ["_i", "_j"]).drop("_i", "_j")


def with_category(df: DataFrame, categories: DataFrame, on: str = "cell_id") -> DataFrame:
    return df.join(categories, on)


def mark_sampled(cells: DataFrame, sampled: DataFrame, on: str = "cell_id") -> DataFrame:
    """A flag on every cell: is it in the sample?"""
    return cells.join(sampled.select(on, F.lit(True).alias("sampled")).distinct(), on, "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))
