"""Job: calibration targets that match the simulation's distribution, with masks, as whole series of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracube.operators import grid as g
from terracube.operators import sequences as sq
from terracube.operators import stats as st


def run(dynamic: DataFrame, sim: DataFrame, obs: DataFrame, static: DataFrame, target: str, reference: tuple[str, str], dynamic_inputs: Sequence[str], static_inputs: Sequence[str], max_gaps: int, method: str = "zscore") -> DataFrame:
    """One row a valid cell: steps, inputs and matched target as arrays, static features.

    ``sim`` and ``obs`` hold (cell_id, t, target). Times are those observed; cells drop out whose static features are incomplete or
    whose target has more than ``max_gaps`` days without a value.
    """
    matched = st.match_distribution(obs, g.time_range(sim, *reference), target, method)
    masks = g.missing_cells(static, static_inputs, "mask_static").select("cell_id", "mask_static", *static_inputs)
    masks = masks.join(st.target_mask_min_samples(obs, target, max_gaps).select("cell_id", F.col("mask").alias("mask_target")), "cell_id")
    cells = g.valid_cells(g.combine_masks(masks, ["mask_static", "mask_target"]))
    rows = g.on_times_of(dynamic.select("cell_id", "t", *dynamic_inputs), matched)
    rows = rows.join(matched.select("cell_id", "t", F.col(f"{target}_matched").alias("y")), ["cell_id", "t"], "left")
    rows = g.feature_vectors(rows.join(cells.select("cell_id"), "cell_id", "left_semi"), dynamic_inputs, "xd")
    series = sq.cell_series(rows, ["xd", "y"], t="t")
    return series.join(g.feature_vectors(cells, static_inputs, "xs").select("cell_id", "xs"), "cell_id")
