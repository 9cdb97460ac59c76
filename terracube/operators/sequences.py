"""Series of a cell cut into sequences. The blow-up of overlapping windows stays inside arrays.

A cell's series is gathered once into arrays sorted by time; a sequence is a slice of them, made only for the starts asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracube.operators.ordered import running_sum


def cell_series(df: DataFrame, variables: Sequence[str], cell: str = "cell_id", t: str = "t_i") -> DataFrame:
    """One row a cell: ``t`` and each variable as arrays in the order of time."""
    rows = F.array_sort(F.collect_list(F.struct(t, *variables))).alias("_s")
    return df.groupBy(cell).agg(rows).select(cell, F.col(f"_s.{t}").alias("steps"), *[F.col(f"_s.{v}").alias(v) for v in variables])


def _windows(series: DataFrame, variables: Sequence[str], length: int, at: str, first: Column, n: Column, starts: DataFrame | None, cell: str) -> DataFrame:
    if starts is None:
        cut = series.withColumn(at, F.explode(F.when(n > 0, F.sequence(first, first + n - 1))))
    elif cell in starts.columns:
        cut = series.join(starts.select(cell, at), cell).where((F.col(at) >= first) & (F.col(at) < first + n))
    else:  # the same starts for all cells, at most one a time step
        cut = series.join(F.broadcast(starts.select(at).distinct())).where((F.col(at) >= first) & (F.col(at) < first + n))
    begin = F.col(at) - first + 1
    return cut.select(cell, at, *[F.slice(v, begin, F.lit(length)).alias(v) for v in variables])


def forward_sequences(series: DataFrame, variables: Sequence[str], length: int, include_last: bool = False, starts: DataFrame | None = None, cell: str = "cell_id") -> DataFrame:
    """Steps t0 .. t0 + L - 1 for t0 in [0, T - L); ``include_last`` adds the window that ends with the series."""
    n = F.size(variables[0]) - F.lit(length) + F.lit(int(include_last))
    return _windows(series, variables, length, "t0", F.lit(0), n, starts, cell)


def trailing_sequences(series: DataFrame, variables: Sequence[str], length: int, include_first: bool = False, starts: DataFrame | None = None, cell: str = "cell_id") -> DataFrame:
    """Steps t - L + 1 .. t for t in [L, T); ``include_first`` adds the window that begins the series."""
    first = F.lit(length - int(include_first))
    n = F.size(variables[0]) - first
    cut = _windows(series, variables, length, "t", first, n, starts, cell) if starts is not None else series.withColumn("t", F.explode(F.when(n > 0, F.sequence(first, first + n - 1))))
    if starts is not None:
        return cut
    return cut.select(cell, "t", *[F.slice(v, F.col("t") - F.lit(length) + 2, F.lit(length)).alias(v) for v in variables])


def slab_series(df: DataFrame, variables: Sequence[str], slab: int, halo: int, cell: str = "cell_id", t: str = "t_i") -> DataFrame:
    """Series in slabs of ``slab`` steps with ``halo`` steps of what follows: (cell, slab, variables as arrays). No row holds more than slab + halo steps, and
    no task sorts a whole series: steps are numbered bucket by bucket."""
    placed = running_sum(df.select(cell, t, *variables), [cell], t, F.lit(1), "_place")
    first = F.greatest(F.floor((F.col("_place") - halo) / F.lit(slab)), F.lit(0))
    dealt = placed.withColumn("slab", F.explode(F.sequence(first, F.floor(F.col("_place") / F.lit(slab)))))
    rows = F.array_sort(F.collect_list(F.struct("_place", *variables))).alias("_s")
    return dealt.groupBy(cell, "slab").agg(rows).select(cell, "slab", *[F.col(f"_s.{v}").alias(v) for v in variables])


def forward_windows(df: DataFrame, variables: Sequence[str], length: int, slab: int = 1_024, include_last: bool = False, cell: str = "cell_id", t: str = "t_i") -> DataFrame:
    """What `forward_sequences` cuts from `cell_series`, for series of any length: each window comes from the slab in which it begins.

    A slab's halo shows whether a window is the last one of its series, so that no one has to know the series' length. A NULL cell is a cell.
    """
    series = slab_series(df, variables, slab, length - int(include_last), cell, t)
    n = F.least(F.lit(slab), F.size(variables[0]) - length + int(include_last))
    cut = series.withColumn("_i", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return cut.select(cell, (F.col("slab") * slab + F.col("_i")).cast("int").alias("t0"), *[F.slice(v, F.col("_i") + 1, F.lit(length)).alias(v) for v in variables])


def trailing_windows(df: DataFrame, variables: Sequence[str], length: int, slab: int = 1_024, include_first: bool = False, cell: str = "cell_id", t: str = "t_i") -> DataFrame:
    """What `trailing_sequences` cuts, for series of any length."""
    cut = forward_windows(df, variables, length, slab, True, cell, t).where(F.col("t0") >= 1 - int(include_first))
    return cut.select(cell, (F.col("t0") + length - 1).alias("t"), *variables)


def select_steps(df: DataFrame, column: str, steps: int | str = "all") -> DataFrame:
    """All steps of a predicted sequence, the last one (0), or step n."""
    if steps == "all":
        return df
    return df.withColumn(column, F.element_at(column, -1) if steps == 0 else F.try_element_at(F.col(column), F.lit(int(steps) + 1)))
