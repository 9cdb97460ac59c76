"""Whitening of vectors: covariance over distinct vectors by weighted centred products, each distinct vector whitened once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, salted_join, stash

COMPONENTS = 4
ADDERS = 16
#: A component whose eigenvalue is a smaller share of the trace has no spread that could be scaled to 1.
LEAST_SHARE = 1e-10
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def floored(df: DataFrame, keep: tuple[str, ...] = (), id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, ``x`` = floor(scale * c) of each component c as a long, and the columns ``keep``. Rows with a null or empty vector, or a null or non-finite
    component take no part. A component that a long can't hold raises."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    good = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, whole).alias("x"), *keep)


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sums(width: int):
    """For each dimension the exact sum of weight times component, as whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            if batch.num_rows:
                x, w = _matrix(batch, "x"), batch.column("w").to_numpy()
                if float(np.abs(x.astype(float)).max()) * float(w.max()) * len(x) >= 2.0**62:
                    x, w = x.astype(object), w.astype(object)
                n += int(w.sum())
                total = [a + int(b) for a, b in zip(total, w @ x, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([Decimal(v) for v in [*total, n]], pa.decimal128(38, 0))], ["i", "s"])

    return run


def _products(column: str, mean: np.ndarray):
    """A task's sum of weighted products of centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                away = _matrix(batch, column) - mean
                total += (away * batch.column("w").to_numpy()[:, None]).T @ away
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0.0
    for batch in batches:
        for m in batch.column("m").to_pylist():
            total = total + np.frombuffer(m)
    if not isinstance(total, float):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])


def covariance(fit: DataFrame, column: str, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of the arrays of numbers in ``column``, weighed by ``w``: centred, then multiplied, batch by batch.

    Each task leaves one matrix of width x width; ``ADDERS`` tasks add these up one after another, and the driver adds what they leave.
    """
    parts = fit.select(column, "w").mapInArrow(_products(column, mean), "m binary")
    rows = parts.repartition(ADDERS).mapInArrow(_added, "m binary").toArrow().column("m").to_pylist()
    return sum((np.frombuffer(m) for m in rows), np.zeros(len(mean) ** 2)).reshape(len(mean), len(mean)) / n


def _whitened(sums: list[int], n: int, axes: np.ndarray):
    mean, most = np.array([s / n for s in sums]), max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            if (n * float(np.abs(x.astype(float)).max()) + most) ** 2 * x.shape[1] < 2.0**62:
                away = ((n * x - np.array(sums)) ** 2).sum(axis=1)
            else:
                away = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
                if max(away) >= 1 << 63:
                    raise OverflowError("a deviation does not fit a long")
            y = (x - mean) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("x"), batch.column("w"), pa.array(away.tolist(), pa.int64()), lists], ["h", "x", "w", "deviation", "y"])

    return run


def whiten(rows: DataFrame, k: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """Vectors along their ``k`` widest components, each scaled to variance 1: (vec_id, component, n, deviation, whitened, explained, identity_error).

    ``rows`` holds ``vec_id`` and ``x`` (array of longs). Equal vectors are grouped first; the fit weighs each distinct vector by 1 (``weights="one"``) or by its
    rows ("count"), ``n`` is the sum of the weights. Each distinct vector is whitened once and joined back to its rows; rows of a vector that very many share are
    spread over tasks. The sums S are exact, ``deviation`` is the exact sum of (n * x - S)^2 and raises if a long can't hold it. Components are numbered from 1 by
    falling eigenvalue; the largest entry of each is positive. ``explained`` is the share of the trace; ``identity_error`` the largest absolute entry of the
    whitened rows' covariance minus the identity, measured over the fit list.

    Rows that repeat an id, or have none, each get their own; vectors of another width are a fit of their own; components without spread give no rows, so that a single
    distinct vector gives none; an empty table gives an empty one. Other columns of ``rows`` are left out, whatever they are called. The driver holds a matrix
    of width x width.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    spark = rows.sparkSession
    rows = stash(rows.select("vec_id", "x", F.xxhash64("x").alias("h")))
    distinct = stash(rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("rows")).withColumn("w", F.lit(1).cast("long") if weights == "one" else F.col("rows")))
    widths = [r["width"] for r in distinct.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1))).orderBy("width").collect()]
    hot = hot_keys(distinct, ["h", "x"], "rows", rows.count())
    out = spark.createDataFrame([], OUT)
    for width in widths:
        own = distinct.where(F.size("x") == width).select("h", "x", "w")
        found = own.select("x", "w").mapInArrow(_sums(width), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        *sums, n = (int(r["s"]) for r in found)
        v = covariance(own, "x", np.array([s / n for s in sums]), n)
        e, p = (a[..., ::-1] for a in np.linalg.eigh((v + v.T) / 2))
        kept = min(k, int((e > LEAST_SHARE * np.trace(v)).sum()))
        if not kept:
            continue
        p = p[:, :kept] * np.sign(p[np.abs(p[:, :kept]).argmax(axis=0), np.arange(kept)])
        once = stash(own.mapInArrow(_whitened(sums, n, p / np.sqrt(e[:kept])), "h long, x array<long>, w long, deviation long, y array<double>"))
        means = once.agg(*[F.sum(F.get("y", F.lit(i)) * F.col("w")) / n for i in range(kept)]).first()
        error = float(np.abs(covariance(once, "y", np.array(means), n) - np.eye(kept)).max())
        back = salted_join(rows.where(F.size("x") == width), once.drop("w"), ["h", "x"], hot)
        shares = F.array(*[F.lit(float(s)) for s in e[:kept] / np.trace(v)])
        long = back.select("vec_id", "deviation", F.posexplode("y").alias("i", "whitened"))
        out = out.unionByName(long.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error")))
    return out


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(floored(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))
