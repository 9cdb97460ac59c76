"""Overlapping blocks in space and time: their catalogue, and the rows that belong to them.

The catalogue is made of sequences along each axis. Rows find their blocks by arithmetic: index i lies in the blocks
k of stride s and size w with ceil((i - w + 1) / s) <= k <= floor(i / s), so the fan-out is an explode and an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _count(n: int, size: int, over: int) -> int:
    if size - over <= 0:
        raise ValueError("the overlap is smaller than the size")
    return -(-n // (size - over))


def _with_bounds(df: DataFrame, n: int, size: int, over: int, name: str) -> DataFrame:
    """First and end index (cut at the edge) of each block of an axis."""
    first = F.col(f"i{name}") * (size - over)
    return df.withColumns({f"{name}0": first, f"{name}1": F.least(first + size, F.lit(n))})


def axis_blocks(spark, n: int, size: int, over: int, name: str) -> DataFrame:
    """Blocks of one axis: number along the axis, first and end index (cut at the edge)."""
    k = spark.range(_count(n, size, over)).select(F.col("id").cast("int").alias(f"i{name}"))
    return _with_bounds(k, n, size, over, name)


def spatial_cubelets(spark, n_lat: int, n_lon: int, xsize: int, ysize: int, xover: int = 0, yover: int = 0, keep_degenerate: bool = False, mask: DataFrame | None = None, missing_policy: str | float = "all") -> DataFrame:
    """Tiles of the grid, longitude outer and latitude inner: (s_idx, ix, iy, x0, x1, y0, y1, kept, reason).

    Kept tiles are numbered from 0 in this order; others have no number and a reason: ``degenerate`` (smaller than asked for) or
    ``missing``: all masked ("all"), any masked ("any"), or a masked share above a number. ``mask`` has (lat_i, lon_i, mask).
    """
    rows = _count(n_lat, ysize, yover)
    tiles = spark.range(_count(n_lon, xsize, xover) * rows).select(F.expr(f"id div {max(rows, 1)}").cast("int").alias("ix"), (F.col("id") % max(rows, 1)).cast("int").alias("iy"))
    tiles = _with_bounds(_with_bounds(tiles, n_lon, xsize, xover, "x"), n_lat, ysize, yover, "y")
    degenerate = (F.col("x1") - F.col("x0") < xsize) | (F.col("y1") - F.col("y0") < ysize)
    tiles = tiles.withColumn("degenerate", degenerate)
    missing: Column = F.lit(False)
    if mask is not None:
        inside = _fan_out(_fan_out(mask.where("mask"), "lon_i", "ix", xsize, xover, n_lon), "lat_i", "iy", ysize, yover, n_lat)
        tiles = tiles.join(inside.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("_m")), ["ix", "iy"], "left")
        masked, total = F.coalesce("_m", F.lit(0)), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        missing = masked == total if missing_policy == "all" else masked > 0 if missing_policy == "any" else masked / total > F.lit(float(missing_policy))
    reason = F.when(F.col("degenerate") & F.lit(not keep_degenerate), F.lit("degenerate")).when(missing, F.lit("missing"))
    tiles = tiles.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())
    # numbers of kept tiles: those of earlier columns of tiles, and those before in the own column
    columns = tiles.groupBy("ix").agg(F.sum(F.col("kept").cast("int")).alias("_c"))
    columns = columns.select("ix", F.coalesce(F.sum("_c").over(Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a tile column
    own = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("ix").orderBy("iy")) - 1
    numbered = tiles.withColumn("_own", own).join(columns, "ix").withColumn("s_idx", F.when(F.col("kept"), (F.col("_before") + F.col("_own")).cast("int")))
    return numbered.select("s_idx", "ix", "iy", "x0", "x1", "y0", "y1", "kept", "reason")


def time_cubelets(spark, n_times: int, tsize: int, tover: int = 0, keep_degenerate: bool = False) -> DataFrame:
    """Blocks of the time axis: (k_idx, it, t0, t1, kept). Only blocks at the end can be cut short, so kept ones come first."""
    blocks = axis_blocks(spark, n_times, tsize, tover, "t")
    kept = (F.col("t1") - F.col("t0") == tsize) | F.lit(keep_degenerate)
    return blocks.withColumn("kept", kept).select(F.when(F.col("kept"), F.col("it")).alias("k_idx"), "it", "t0", "t1", "kept")


def catalogue(space: DataFrame, time: DataFrame) -> DataFrame:
    """Every kept tile with every kept time block. The time blocks, a list as short as the axis, go to the tiles as one array."""
    s = space.where("kept").select("s_idx", "ix", "iy", "x0", "x1", "y0", "y1")
    blocks = time.where("kept").agg(F.collect_list(F.struct("k_idx", "it", "t0", "t1")).alias("_t"))
    return s.join(F.broadcast(blocks)).select(*s.columns, F.explode("_t").alias("_t")).select(*s.columns, "_t.*")


def _fan_out(df: DataFrame, index: str, name: str, size: int, over: int, n: int) -> DataFrame:
    stride = size - over
    last = -(-n // stride) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col(index) - size + 1) / F.lit(float(stride))).cast("int"))
    high = F.least(F.lit(last), F.floor(F.col(index) / F.lit(float(stride))).cast("int"))
    return df.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))


def members(df: DataFrame, blocks: DataFrame, sizes: tuple[int, int, int], overs: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """A row for each block that a grid row (lat_i, lon_i, t_i) lies in; sizes, overlaps and shape along x, y, t.

    Rows meet the tiles of the catalogue before they are repeated for its time blocks; blocks that aren't in it drop out by an equality join on (ix, iy, it).
    """
    out = df
    for (index, name), size, over, n in zip((("lon_i", "ix"), ("lat_i", "iy"), ("t_i", "it")), sizes, overs, shape, strict=True):
        out = _fan_out(out, index, name, size, over, n)
        if name == "iy":
            out = out.join(blocks.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    return out.join(blocks, ["ix", "iy", "it"]).drop("ix", "iy", "it")
