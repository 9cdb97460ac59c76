"""Job: align predictions with truth, score every cell, and sum up over cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from terracube.functions.transforms import with_uncertainty
from terracube.operators import evaluate as ev
from terracube.operators import grid as g
from terracube.operators import stats as st


def run(true: DataFrame, pred: DataFrame, masks: DataFrame | None = None, stats: DataFrame | None = None, metrics: Sequence[str] = ("rmse", "bias", "pbias", "pearson", "nse", "kge"), on: Sequence[str] = ("cell_id", "t")) -> tuple[DataFrame, DataFrame]:
    """Maps (a row a cell) and the table of mean ± std over cells. ``true`` has y_true and ``pred`` y_pred beside the keys.

    One shuffle by the keys for the join, one by cell for all metrics together.
    """
    both = g.align(true, pred, on)
    if masks is not None:
        both = g.mask_values(both, masks, ["y_true", "y_pred"])
    if stats is not None:
        both = st.unscale(both, stats, ["y_true", "y_pred"])
    maps = ev.skill(both, ["cell_id"], metrics)
    table = ev.global_table(maps, metrics)
    return maps, table.withColumn("shown", with_uncertainty(table["mean"], table["std"]))
