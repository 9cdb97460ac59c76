"""Job: scaled sequences with static attributes, from a dynamic and a static grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracube.functions.transforms import preprocess
from terracube.operators import grid as g
from terracube.operators import sampling as sp
from terracube.operators import sequences as sq
from terracube.operators import stats as st
from terracube.sources import grids as io


@dataclass
class SampleConfig:
    dynamic_inputs: Sequence[str]
    static_inputs: Sequence[str]
    targets: Sequence[str]
    masks: Sequence[str]
    period: tuple[str, str]
    length: int
    variants: Mapping[str, str] = field(default_factory=dict)
    static_variants: Mapping[str, str] = field(default_factory=dict)
    transforms: Mapping[str, Sequence[str]] = field(default_factory=dict)
    cell_fraction: float = 1.0
    start_fraction: float = 1.0
    seed: int = 0
    is_train: bool = True
    stats_path: str | None = None


def run(dynamic: DataFrame, static: DataFrame, cfg: SampleConfig) -> DataFrame:
    """One row a (cell, first step): xd and y as arrays of feature arrays, xs as an array.

    Statistics come from all cells of the training period, after the transforms and before masks and samples. Cells and starts are sampled
    before any series is built; a cell's series moves once, by cell.
    """
    spark, names = dynamic.sparkSession, [*cfg.dynamic_inputs, *cfg.targets]
    rows = preprocess(g.time_range(dynamic, *cfg.period).select("cell_id", "t", *names), cfg.transforms)

    def scaled(df: DataFrame, variants: Mapping[str, str], group: str) -> DataFrame:
        if not variants:
            return df
        compute = lambda: st.fit(df, variants, group)
        stats = io.load_or_compute(spark, f"{cfg.stats_path}/{group}", compute, cfg.is_train) if cfg.stats_path else compute()
        return st.scale(df, stats, list(variants))

    rows = scaled(rows, cfg.variants, "dynamic")
    cells = g.combine_masks(static, cfg.masks) if cfg.masks else static.withColumn("mask", F.lit(False))
    cells = scaled(g.valid_cells(cells, keep_all=not cfg.is_train).select("cell_id", *cfg.static_inputs), cfg.static_variants, "static")
    if cfg.cell_fraction < 1:
        cells = cells.join(sp.sample_keys(cells, "cell_id", cfg.cell_fraction, seed=cfg.seed), "cell_id", "left_semi")
    days = g.time_index(rows)
    rows = rows.join(cells.select("cell_id"), "cell_id", "left_semi").join(F.broadcast(days), "t")  # one row a time step
    rows = g.feature_vectors(g.feature_vectors(rows, cfg.dynamic_inputs, "xd"), cfg.targets, "y")
    series = sq.cell_series(rows, ["xd", "y"])
    starts = sp.epoch_starts(days.count(), cfg.length, spark, fraction=cfg.start_fraction, seed=cfg.seed) if cfg.start_fraction < 1 else None
    cut = sq.forward_sequences(series, ["xd", "y"], cfg.length, starts=starts)
    return cut.join(g.feature_vectors(cells, cfg.static_inputs, "xs").select("cell_id", "xs"), "cell_id")
