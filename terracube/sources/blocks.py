"""Grids in blocks of space and time along a Morton curve, so that reading a box opens only the files of zones that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("lat_i", "lon_i", "t_i")
#: Blocks a zone along each axis, as a power of two; a zone is a directory.
ZONE_BITS = 2
#: Numbers of blocks along an axis have so many bits.
BLOCK_BITS = 20
#: A box is turned into so many ranges of zones at most; more would only cut more finely, since rows are filtered by the box itself.
MOST_RANGES = 64


def morton(numbers: Sequence[Column], bits: int = BLOCK_BITS) -> Column:
    """Bits of the numbers in turn, the first one's lowest bit last: near numbers have near keys on all axes."""
    n = len(numbers)
    bit = lambda c, k, i: F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), n * k + n - 1 - i)
    key = F.lit(0).cast("long")
    for i, c in enumerate(numbers):
        for k in range(bits):
            key = key.bitwiseOR(bit(c, k, i))
    return key


def write_blocks(df: DataFrame, path: str, sizes: Sequence[int], axes: Sequence[str] = AXES, files: int = 64) -> None:
    """Write rows in the order of their blocks of ``sizes`` steps along the axes, in directories of zones of 4 blocks a side.

    Rows are dealt to ``files`` tasks by ranges of the key, so that a zone has few files and each row group covers a small box. Axes are whole numbers from 0
    to 2^20 blocks; others, and NULL, raise.
    """
    number = [F.floor(F.col(a) / F.lit(s)).cast("long") for a, s in zip(axes, sizes, strict=True)]
    inside = F.lit(True)
    for n in number:
        inside = inside & F.coalesce((n >= 0) & (n < 1 << BLOCK_BITS), F.lit(False))
    key = F.when(inside, morton(number)).otherwise(F.raise_error(F.lit("an axis outside of the blocks")).cast("long"))
    zone = F.shiftright("_key", len(axes) * ZONE_BITS)
    keyed = df.withColumn("_key", key).withColumn("zone", zone)
    keyed.repartitionByRange(files, "_key").sortWithinPartitions("_key").drop("_key").write.mode("overwrite").partitionBy("zone").parquet(path)


def zone_ranges(box: Sequence[tuple[int, int]], sizes: Sequence[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of zones (ends included) that hold every zone a box touches; the box has a first and a last step for each axis."""
    n, bits = len(box), BLOCK_BITS - ZONE_BITS
    low, high = ([max(0, end) // size >> ZONE_BITS for end, size in zip(ends, sizes, strict=True)] for ends in zip(*box, strict=True))
    if any(last < first or last < 0 for first, last in box):
        return []
    todo, found, level = [((0,) * n, 0)], [], bits
    while todo and level > 0 and len(todo) + len(found) <= most // 2:
        level -= 1
        deeper = []
        for corner, code in todo:
            for child in range(1 << n):
                at = tuple(2 * c + (child >> (n - 1 - i) & 1) for i, c in enumerate(corner))
                first, last = [a << level for a in at], [(a + 1 << level) - 1 for a in at]
                if any(b < lo or a > hi for a, b, lo, hi in zip(first, last, low, high, strict=True)):
                    continue
                own = code << n | child
                if all(lo <= a and b <= hi for a, b, lo, hi in zip(first, last, low, high, strict=True)):
                    found.append((own << n * level, (own + 1 << n * level) - 1))
                else:
                    deeper.append((at, own))
        todo = deeper
    found += [(code << n * level, (code + 1 << n * level) - 1) for _, code in todo]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a == joined[-1][1] + 1:
            joined[-1] = joined[-1][0], b
        else:
            joined.append((a, b))
    return joined


def read_box(spark: SparkSession, path: str, sizes: Sequence[int], box: Sequence[tuple[int, int]], axes: Sequence[str] = AXES) -> DataFrame:
    """The rows of a box, ends included: only directories of zones it touches are listed and read, and row groups outside it are skipped by their ends."""
    df = spark.read.parquet(path)
    zones = F.lit(False)
    for a, b in zone_ranges(box, sizes):
        zones = zones | F.col("zone").between(a, b)
    rows = df.where(zones)
    for axis, (first, last) in zip(axes, box, strict=True):
        rows = rows.where(F.col(axis).between(first, last))
    return rows.drop("zone")
