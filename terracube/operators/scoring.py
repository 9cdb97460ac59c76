"""A user's own model or metric, applied to series, blocks or groups by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model takes [rows, steps, features] of numbers and gives [rows, steps, outputs].
Model = Callable[[np.ndarray], np.ndarray]


def score_sequences(sequences: DataFrame, model: Model, x: str, keys: Sequence[str], outputs: Sequence[str] = ("y_hat",)) -> DataFrame:
    """Predictions for rows that hold an array of steps of feature arrays; rows of equal length go to the model together."""
    fields = [sequences.schema[k] for k in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{o}` array<double>" for o in outputs)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf[x].map(len), sort=False):
                y = model(np.array([[np.asarray(step, float) for step in row] for row in part[x]]))
                yield part[list(keys)].assign(**{o: list(y[:, :, i]) for i, o in enumerate(outputs)})

    return sequences.select(*keys, x).mapInPandas(run, schema)


def _series_of(df: DataFrame, keys: Sequence[str], t: str, features: Sequence[str]) -> DataFrame:
    """One row a series: its steps and features in the order of time."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(t), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]))).alias("s"))


def _cubes(batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Series of equal length together: their rows, the places of their steps, and [series, steps, features]."""
    lists = batch.column("s")
    edges, steps = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
    values = np.stack([steps.field(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1)
    sizes = np.diff(edges)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        at = edges[own][:, None] + np.arange(size)
        yield own, at, values[at]


def score_series(df: DataFrame, model: Model, features: Sequence[str], keys: Sequence[str] = ("cell_id",), t: str = "t_i", output: str = "y_hat") -> DataFrame:
    """Predictions for each step of each cell's series. Series are gathered as arrays, and those of equal length in an Arrow batch go to the model
    together."""
    keys, n = list(keys), len(features)
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, t]), f"`{output}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("s")
            steps = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            y = np.zeros(len(steps))
            for _, at, x in _cubes(batch, n):
                y[at] = model(x)[:, :, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), steps.field(t), pa.array(y)], [*keys, t, output])

    return _series_of(df, keys, t, features).mapInArrow(run, schema)


def score_cubelets(members: DataFrame, model: Callable[[np.ndarray], np.ndarray], features: Sequence[str], output: str = "y_hat", stacked: bool = False) -> DataFrame:
    """Predictions for blocks: the model takes [time, feature, lat, lon] and gives [time, lat, lon]; a row for each pixel and step.

    A block's rows are gathered into one list, piece by piece where they are read, and several blocks reach Python in one batch, where they are put into dense arrays
    by position; pixels that a block lacks are NaN. With ``stacked`` blocks of one shape in a batch go to the model together: [blocks, time, feature, lat, lon].
    """
    axes, keys = ("t_i", "lat_i", "lon_i"), ("s_idx", "k_idx")
    schema = f"s_idx int, k_idx int, t_i int, lat_i int, lon_i int, `{output}` double"
    row = F.struct(*[F.col(c).cast("int").alias(c) for c in axes], *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    blocks = members.groupBy(*[F.col(k).cast("int").alias(k) for k in keys]).agg(F.collect_list(row).alias("_rows"))

    def dense(rows: pa.StructArray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        own = [rows.field(c).to_numpy() for c in axes]
        values, at = zip(*(np.unique(c, return_inverse=True) for c in own), strict=True)
        cube = np.full((len(values[0]), len(features), len(values[1]), len(values[2])), np.nan)
        for i in range(len(features)):
            cube[at[0], i, at[1], at[2]] = rows.field(f"f{i}").to_numpy(zero_copy_only=False)
        return cube, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_rows")
            rows, edges = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            made = [dense(rows.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            y = np.zeros(len(rows))
            for shape in {cube.shape for cube, _ in made}:
                own = [i for i, (cube, _) in enumerate(made) if cube.shape == shape]
                given = model(np.stack([made[i][0] for i in own])) if stacked else [model(made[i][0]) for i in own]
                for i, out in zip(own, given, strict=True):
                    y[edges[i] : edges[i + 1]] = out[made[i][1]]
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edges)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), *(rows.field(c) for c in axes), pa.array(y)], [*keys, *axes, output])

    return blocks.mapInArrow(run, schema)


def score_two_stage(static: DataFrame, dynamic: DataFrame, parameters: Callable[[np.ndarray], np.ndarray], bounds: Sequence[tuple[str, float, float]], head: Model, static_features: Sequence[str], dynamic_features: Sequence[str], cell: str = "cell_id", t: str = "t_i") -> DataFrame:
    """Static attributes become bounded parameters, which join the dynamic features of a head model."""
    names = [name for name, _, _ in bounds]
    schema = ", ".join([f"`{cell}` {static.schema[cell].dataType.simpleString()}", *(f"`{n}` double" for n in names)])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = 1 / (1 + np.exp(-parameters(pdf[list(static_features)].to_numpy(float))))
            yield pdf[[cell]].assign(**{n: lo + (hi - lo) * z[:, i] for i, (n, lo, hi) in enumerate(bounds)})

    found = static.select(cell, *static_features).mapInPandas(first, schema)
    return score_series(dynamic.join(found, cell), head, [*dynamic_features, *names], (cell,), t)


def score_samples(df: DataFrame, model: Callable[[np.ndarray, int], np.ndarray], features: Sequence[str], n: int, cell: str = "cell_id", t: str = "t_i", seed: int = 0) -> DataFrame:
    """``n`` passes of a stochastic model over each cell: it is given a seed made from cell and sample. A series is gathered once for all its passes."""
    schema = f"`{cell}` {df.schema[cell].dataType.simpleString()}, sample int, `{t}` {df.schema[t].dataType.simpleString()}, y_hat double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cells = batch.column("s"), batch.column(cell)
            steps = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            series = [(own[j], at[j], x[j : j + 1]) for own, at, x in _cubes(batch, len(features)) for j in range(len(own))]
            for k in range(n):
                y = np.zeros(len(steps))
                for i, at, x in series:
                    y[at] = model(x, (cells[int(i)].as_py() * 1_000_003 + k * 7919 + seed) % (1 << 31))[0, :, 0]
                yield pa.RecordBatch.from_arrays([cells.take(pa.array(row)), pa.array(np.full(len(y), k, np.int32)), steps.field(t), pa.array(y)], [cell, "sample", t, "y_hat"])

    return _series_of(df, [cell], t, features).mapInArrow(run, schema)


def select_outputs(predictions: DataFrame, targets: Sequence[str], keys: Sequence[str] = ("cell_id", "t_i")) -> DataFrame:
    """Of a model's outputs those that a loss or a metric needs; the others are not computed on."""
    return predictions.select(*keys, *targets)


def user_metric(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray], float], keys: Sequence[str], true: str = "y_true", pred: str = "y_pred", name: str = "value") -> DataFrame:
    """A metric that isn't one of the built-in ones, on the pairs of each group. A group without a valid pair gets NULL. A group is in one task's
    memory: keys should be as fine as cells; for larger groups use `user_metric_merged`, or a `Column` of sums (`terracube.functions.metrics`)."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{name}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[[true, pred]].notna().all(axis=1)
        return pdf[list(keys)].head(1).assign(**{name: fn(pdf[true][ok].to_numpy(float), pdf[pred][ok].to_numpy(float)) if ok.any() else None})

    return df.select(*keys, true, pred).groupBy(*keys).applyInPandas(run, schema)


class Metric(Protocol):
    """A metric in two phases: states are arrays of numbers that any number of tasks make from their own rows, and that are merged in any order."""

    def init(self) -> np.ndarray: ...
    def add(self, state: np.ndarray, true: np.ndarray, pred: np.ndarray) -> np.ndarray: ...
    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...
    def finish(self, state: np.ndarray) -> float | None: ...


#: A task hands its states on when it holds so many groups.
GROUPS_A_TASK = 20_000


def user_metric_merged(df: DataFrame, metric: Metric, keys: Sequence[str], true: str = "y_true", pred: str = "y_pred", name: str = "value") -> DataFrame:
    """A user's own metric of each group, however large: each task adds its rows to the states of the groups it meets, states meet by key and are merged.

    A group's rows stay where they are; what moves is one state for each group and task. Pairs with a missing side are left out, a group without a valid pair gets
    NULL, a NULL key is a group. Keys that are equal in Spark are one group; states hold as many numbers as ``init`` gives.
    """
    keys = list(keys)
    text = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("{}")

    def table(states: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"_key": list(states), "_state": [list(map(float, s)) for s in states.values()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[str, np.ndarray] = {}
        for pdf in batches:
            for key, own in pdf.groupby("_key", sort=False):
                ok = own[["_o", "_p"]].notna().all(axis=1)
                state = states.get(key, metric.init())
                states[key] = metric.add(state, own["_o"][ok].to_numpy(float), own["_p"][ok].to_numpy(float)) if ok.any() else state
            if len(states) > GROUPS_A_TASK:
                yield table(states)
                states = {}
        if states:
            yield table(states)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, metric.init()  # rows come sorted by group: one group at a time is merged
        for pdf in batches:
            for key, s in zip(pdf["_key"], pdf["_state"], strict=True):
                if key != held:
                    if held is not None:
                        yield done(held, state)
                    held, state = key, metric.init()
                state = metric.merge(state, np.asarray(s, float))
        if held is not None:
            yield done(held, state)

    def done(key: str, state: np.ndarray) -> pd.DataFrame:
        value = metric.finish(state)
        return pd.DataFrame({"_key": [key], "_value": np.array([np.nan if value is None else value], float)})

    rows = df.select(text.alias("_key"), F.col(true).cast("double").alias("_o"), F.col(pred).cast("double").alias("_p"))
    states = rows.mapInPandas(add, "_key string, _state array<double>")
    merged = states.repartition("_key").sortWithinPartitions("_key").mapInPandas(merge, "_key string, _value double")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    own = [F.from_json("_key", kinds)[k].alias(k) for k in keys]
    return merged.select(*own, F.when(~F.isnan("_value"), F.col("_value")).alias(name))
