"""Hard negatives of anchors: clusters of anchors share a list of candidates sorted by an angular bound, which members walk until they provably can stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash
from .top_k import SAMPLE, Cells, scorer
from .whitening import floored

ROWS_A_SHARD = 8_192
ANCHORS_A_CLUSTER = 256
#: Clusters that one task holds beside a shard; heads of shards and clusters in one row.
CLUSTERS_A_TASK = 32
HEADS_A_ROW = 1_024
STEP = 512
#: Shards that a cluster meets in each round, best bounds first; the last round takes all that are left.
ROUNDS = (2, None)
#: Angles are enlarged by this against rounding: arccos loses half the digits near 0.
SLACK = 1e-6

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
SLOTS = "array<struct<slot int, low long, high long, floor long>>"
HITS = "anchor_id long, slot int, vec_id long, score long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# -- arrays in rows ----------------------------------------------------------------------------


def packed(m: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them, the size of one in front."""
    for kind in (np.int16, np.int32):
        if not m.size or (m.min() >= np.iinfo(kind).min and m.max() <= np.iinfo(kind).max):
            return bytes([np.dtype(kind).itemsize]) + m.astype(kind).tobytes()
    return bytes([8]) + m.astype(np.int64).tobytes()


def unpacked(b: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(b, f"i{b[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (of zero vectors: zero) and lengths."""
    real = m.astype(np.float64)
    length = np.sqrt((real**2).sum(axis=1))
    return real / np.where(length > 0, length, 1)[:, None], length


def cone(m: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction in the middle of the vectors, and the greatest angle between it and one of them."""
    u, length = units(m)
    u = u[length > 0]
    if not len(u):
        return np.eye(1, m.shape[1])[0], 0.0
    middle = u.mean(axis=0)
    size = np.sqrt((middle**2).sum())
    middle = middle / size if size > 1e-6 else u[0]
    return middle, float(np.arccos(np.clip(u @ middle, -1, 1)).max()) + SLACK


# -- the walk ----------------------------------------------------------------------------------


class SharedList:
    """The candidates of a shard in the order of a cluster's angular bound: no member of length s has a greater product with a candidate than s times its bound."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray, middle: np.ndarray, angle: float):
        u, length = units(vectors)
        away = np.arccos(np.clip(u @ middle, -1, 1)) - angle - SLACK
        bound = length * np.cos(np.maximum(away, 0))
        order = np.lexsort((ids, -bound))
        self.ids, self.vectors, self.labels, self.bound, self.longest = ids[order], vectors[order], labels[order], bound[order], float(length.max(initial=0))

    def walk(self, anchors: np.ndarray, vectors: np.ndarray, labels: np.ndarray, slots: dict[str, np.ndarray], k: int, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slot (a member and the scores it asks for) its best ``k`` rows here that may belong to its best ``k`` overall. A member leaves the list where
        the bound falls below the kth score of all its slots."""
        of, floor = slots["of"], slots["floor"].copy()
        length = units(vectors)[1]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in of]
        score = scorer(self.vectors, vectors)
        for a in range(0, len(self.ids), STEP):
            reach = length * self.bound[a] + length * self.longest * 1e-9 + 1
            open_ = np.flatnonzero(reach[of] >= floor)
            if not len(open_):
                break
            b = min(a + STEP, len(self.ids))
            members = np.unique(of[open_])
            found = {m: score(a, b, m) for m in members.tolist()}
            for j in open_.tolist():
                m = of[j]
                s = found[m]
                keep = (s >= floor[j]) & (s <= slots["high"][j]) & ((self.labels[a:b] == labels[m]) == same) & (self.ids[a:b] != anchors[m])
                if not keep.any():
                    continue
                ids, scores = np.concatenate([best[j][0], self.ids[a:b][keep]]), np.concatenate([best[j][1], s[keep]])
                first = np.lexsort((ids, ~scores))[:k]
                best[j] = ids[first], scores[first]
                if len(first) == k:
                    floor[j] = max(floor[j], scores[first[-1]])
        for j, (ids, scores) in enumerate(best):
            if len(ids):
                yield j, ids, scores


# -- shards, clusters and their heads ----------------------------------------------------------


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            x = batch.column("x")
            sizes = np.diff(x.offsets.to_numpy())
            cell = -sizes.astype(np.int64)  # other widths are cells of their own
            same = np.flatnonzero(sizes == cells.width)
            if len(same):
                u, _ = units(x.take(pa.array(same)).flatten().to_numpy().reshape(len(same), -1))
                cell[same] = cells(u)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _gathered(df: DataFrame, cells, size: int, name: str) -> DataFrame:
    """A column ``name``: groups of about ``size`` rows of near directions, dealt by hash within a cell, so that a cell of many equal rows is no hot group."""
    df = stash(df.mapInArrow(_dealt(cells), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema.fields)}, cell long"))
    parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))
    return df.join(F.broadcast(parts), "cell").withColumn(name, F.xxhash64("cell", F.pmod(F.xxhash64("vec_id", "x", "label"), F.col("parts")))).drop("cell", "parts")  # a row for each of at most SAMPLE / 8 cells and for each width


SHARD = "shard long, width int, n int, ids binary, vectors binary, labels binary, middle binary, angle double, longest double"
CLUSTER = "cluster long, width int, n int, ids binary, vectors binary, labels binary, slots binary, middle binary, angle double, need double"


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    m = np.stack(pdf["x"].to_list()).astype(np.int64)
    middle, angle = cone(m)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "width": [m.shape[1]], "n": [len(m)], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [packed(m)], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "middle": [middle.tobytes()], "angle": [angle], "longest": [float(units(m)[1].max())]})


def _cluster(pdf: pd.DataFrame) -> pd.DataFrame:
    """Members of a cluster with their slots as rows (member, slot, low, high, floor), and the least bound that some slot needs."""
    m = np.stack(pdf["x"].to_list()).astype(np.int64)
    middle, angle = cone(m)
    slots = np.array([(i, s["slot"], s["low"], s["high"], max(s["low"], s["floor"])) for i, own in enumerate(pdf["slots"]) for s in own], np.int64).reshape(-1, 5)
    length = units(m)[1][slots[:, 0]]
    need = np.where(length > 0, (slots[:, 4].astype(float) - 1) / np.where(length > 0, length, 1), -np.inf)
    row = {"ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [packed(m)], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "slots": [slots.tobytes()], "middle": [middle.tobytes()], "angle": [angle], "need": [float(need.min())]}
    return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "width": [m.shape[1]], "n": [len(m)], **row})


def _heads(df: DataFrame, key: str, number: str) -> DataFrame:
    """Cones of about ``HEADS_A_ROW`` shards or clusters in one row."""
    value = "longest" if key == "shard" else "need"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "width": [pdf["width"].iloc[0]], number: [pdf[key].to_numpy(np.int64).tobytes()], f"{number}_m": [b"".join(pdf["middle"])], f"{number}_a": [pdf["angle"].to_numpy(float).tobytes()], f"{number}_v": [pdf[value].to_numpy(float).tobytes()]})

    rows = max(1, -(-df.count() // HEADS_A_ROW))
    own = df.select(key, "width", "middle", "angle", value, F.pmod(F.xxhash64(key), F.lit(rows)).cast("int").alias("row"))
    return own.groupBy("row", "width").applyInPandas(run, f"row int, width int, {number} binary, {number}_m binary, {number}_a binary, {number}_v binary")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, shard, bound) where the shard may hold a score that some slot of the cluster needs."""
    for batch in batches:
        for r in batch.to_pylist():
            real = {n: np.frombuffer(r[n], np.int64 if n in "sc" else np.float64) for n in ("s", "s_m", "s_a", "s_v", "c", "c_m", "c_a", "c_v")}
            away = np.arccos(np.clip(real["c_m"].reshape(len(real["c"]), -1) @ real["s_m"].reshape(len(real["s"]), -1).T, -1, 1)) - SLACK
            bound = real["s_v"] * np.maximum(0, np.cos(np.clip(away - real["c_a"][:, None] - real["s_a"], 0, np.pi)))
            i, j = np.nonzero(bound + real["s_v"] * 1e-9 >= real["c_v"][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(real["c"][i]), pa.array(real["s"][j]), pa.array(bound[i, j])], ["cluster", "shard", "bound"])


def _walked(k: int, same: bool):
    def run(shard: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own in shard.itertuples():
            ids, labels, vectors = np.frombuffer(own.ids, np.int64), np.frombuffer(own.labels, np.int64), unpacked(own.vectors, own.n)
            for c in clusters.itertuples():
                anchors, table = np.frombuffer(c.ids, np.int64), np.frombuffer(c.slots, np.int64).reshape(-1, 5)
                slots = {"of": table[:, 0], "high": table[:, 3], "floor": table[:, 4]}
                candidates = SharedList(ids, vectors, labels, np.frombuffer(c.middle), c.angle)
                for j, found, scores in candidates.walk(anchors, unpacked(c.vectors, c.n), np.frombuffer(c.labels, np.int64), slots, k, same):
                    out.append(pd.DataFrame({"anchor_id": anchors[table[j, 0]], "slot": np.int32(table[j, 1]), "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": np.zeros(0, np.int64), "slot": np.zeros(0, np.int32), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    return run


# -- all shards --------------------------------------------------------------------------------


def best_of(shards: DataFrame, heads: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """For each anchor and slot the first ``k`` rows of the same (or of another) label whose scores lie in the slot's range: (anchor_id, slot, vec_id, score)."""
    rows_of_heads = heads.agg(F.coalesce(F.max("row"), F.lit(0))).first()[0]
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    hits, done = None, None
    for take in ROUNDS:
        known = anchors
        if hits is not None:
            kth = hits.groupBy(F.col("anchor_id").alias("vec_id"), "slot").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
            kth = kth.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))  # a few slots an anchor
            floor = lambda s: F.coalesce(F.try_element_at(F.col("kth"), s["slot"]), s["floor"])
            raised = F.transform("slots", lambda s: F.struct(s["slot"], s["low"], s["high"], floor(s).alias("floor")))
            known = anchors.join(kth, "vec_id", "left").withColumn("slots", raised).drop("kth")
        clusters = stash(known.groupBy("cluster", F.size("x")).applyInPandas(_cluster, CLUSTER))
        to_meet = _heads(clusters, "cluster", "c").drop("row").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows_of_heads))))
        pairs = to_meet.join(heads, ["row", "width"]).drop("row", "width").mapInArrow(_met, "cluster long, shard long, bound double")
        if done is not None:
            pairs = pairs.join(done, ["cluster", "shard"], "left_anti")
        if take is not None:
            pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "shard"))).where(F.col("place") <= take)
        pairs = stash(pairs.select("cluster", "shard"))
        # a shard moves once for every CLUSTERS_A_TASK clusters it meets
        parts = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(CLUSTERS_A_TASK)).cast("int").alias("parts"))
        left = shards.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = pairs.join(parts, "shard").join(clusters, "cluster").withColumn("part", F.pmod(F.xxhash64("cluster"), F.col("parts")).cast("int")).drop("parts")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from the pairs
        found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_walked(k, same), HITS)
        every = found if hits is None else hits.unionByName(found)
        hits = stash(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        done = pairs if done is None else done.unionByName(pairs)
    return hits


def _slots(low: Column, high: Column, slot: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"), low.cast("long").alias("floor"))


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its positives the rows of other labels whose score is from ``low`` to ``high`` percent of the positive's:
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Both tables hold ``vec_id``, ``x`` (array of longs) and ``label``. A row's score is its inner product with the anchor; higher ones come first, ties by smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of its label, its negatives the first ``negatives`` in range.

    Rows are dealt into shards of near directions, anchors into clusters. A cluster has a middle direction and the greatest angle between it and a member; with a
    candidate at angle t to the middle no member of length s scores above s * length * cos(max(0, t - angle)). In each shard the candidates are sorted by this
    bound once for a cluster, and every member walks that list until the bound is below the kth score of everything it asks for. The list of a cluster is kept
    shard by shard, so that no task holds all candidates. A first round meets the two shards of the best bounds, the second those that the kth scores so far
    don't rule out. Positives come first, since they set the ranges of the negatives, which walk again with one slot for each positive.

    Scores are exact; one that a long can't hold raises. Rows without a label, id or vector take no part. Rows that repeat an id are all candidates, but none is
    an other row of an anchor of that id; of anchors that repeat an id the one with the least label and vector asks. Vectors of another width than the anchor's
    never meet it. An anchor without another row of its label, or without rows in range, has no rows. Other columns are left out, whatever they are called.
    Empty tables give no rows.
    """
    spark = rows.sparkSession
    rows, anchors = (df.select("vec_id", "x", F.col("label").cast("long").alias("label")).dropna() for df in (rows, anchors))
    widths = rows.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], OUT)
    anchors = stash(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("a")).select("vec_id", "a.x", "a.label"))

    def cells(df: DataFrame, size: int):
        sample = df.where(F.size("x") == widths[0]["w"]).orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").toPandas()["x"]
        known = units(np.stack(sample.to_list()))[0] if len(sample) else np.zeros((0, widths[0]["w"]))
        return spark.sparkContext.broadcast(Cells(known, min(SAMPLE // 8, max(1, -(-df.count() // size)))))

    shards = stash(_gathered(rows, cells(rows, ROWS_A_SHARD), ROWS_A_SHARD, "shard").groupBy("shard", F.size("x")).applyInPandas(_shard, SHARD))
    heads = stash(_heads(shards, "shard", "s"))
    anchors = stash(_gathered(anchors, cells(anchors, ANCHORS_A_CLUSTER), ANCHORS_A_CLUSTER, "cluster"))

    every = F.array(_slots(F.lit(LOWEST), F.lit(HIGHEST), F.lit(0)))
    near = best_of(shards, heads, anchors.withColumn("slots", every), positives, True)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = stash(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), rank.alias("slot")))
    # whole scores in range: 100 n >= low p and 100 n <= high p; decimals, since a long can't hold 100 p for every p
    p = F.col("positive_score").cast("decimal(20,0)")
    asked = near.withColumns({"low": F.ceil(p * low / 100).cast("long"), "high": F.floor(p * high / 100).cast("long")}).where("low <= high")
    asked = asked.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(_slots(F.col("low"), F.col("high"), F.col("slot"))).alias("slots"))  # one a positive
    far = best_of(shards, heads, anchors.join(asked, "vec_id"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    ranked = far.select("anchor_id", "slot", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), rank.alias("rank"))
    return ranked.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = floored(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null"), ("label",))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
