"""Exact top-k inner products: a ball tree for each shard, searched by branch and bound with a shared kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

LEAF = 64
VECTORS_A_SHARD = 4_096
QUERIES_A_BLOCK = 512
SAMPLE = 8_192
#: Root balls, or balls of blocks, in one row; blocks that one task holds beside a shard's tree.
BALLS_A_ROW = 1_024
BLOCKS_A_TASK = 32
#: Shards that a block of queries meets in each round, best bounds first; the last round takes all that are left.
ROUNDS = (1, 8, None)
EVERY = 50

HITS = "query_id long, vec_id long, score long"
TREE = "shard long, width int, ids binary, vectors binary, centre binary, radius binary, nodes binary"


# -- one shard ---------------------------------------------------------------------------------


class BallTree:
    """Nodes with a centre and a radius; leaves hold ``leaf`` vectors or fewer. Splits go through two far points."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, radius: np.ndarray, nodes: np.ndarray):
        self.ids, self.vectors, self.centre, self.radius, self.nodes = ids, vectors, centre, radius, nodes  # nodes: first child or 0, first row, end row

    @classmethod
    def grow(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, real = np.arange(len(ids)), vectors.astype(np.float64)
        centre, radius, nodes = [], [], []

        def node(a: int, b: int) -> int:
            own = real[order[a:b]]
            centre.append(own.mean(axis=0))
            radius.append(float(np.sqrt(((own - centre[-1]) ** 2).sum(axis=1).max())))
            nodes.append([0, a, b])
            return len(nodes) - 1

        todo = [node(0, len(ids))]
        while todo:
            at = todo.pop()
            _, a, b = nodes[at]
            if b - a <= leaf or radius[at] == 0:
                continue
            part = order[a:b]
            own = real[part]
            one = own[np.argmax(((own - centre[at]) ** 2).sum(axis=1))]
            two = own[np.argmax(((own - one) ** 2).sum(axis=1))]
            order[a:b] = part[np.argsort(own @ (two - one), kind="stable")]
            m = (a + b) // 2
            nodes[at][0] = node(a, m)
            node(m, b)
            todo += [nodes[at][0], nodes[at][0] + 1]
        return cls(ids[order], vectors[order], np.array(centre), np.array(radius), np.array(nodes))

    def columns(self) -> dict[str, list[bytes]]:
        return {c: [getattr(self, c).tobytes()] for c in ("ids", "vectors", "centre", "radius", "nodes")}

    @classmethod
    def of(cls, row: dict) -> BallTree:
        ids, radius = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["radius"])
        return cls(ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1), np.frombuffer(row["centre"]).reshape(len(radius), -1), radius, np.frombuffer(row["nodes"], np.int64).reshape(-1, 3))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The best ``k`` of this shard for each query that may still beat ``floor`` (kth score so far)."""
        bounds = upper_bounds(queries, self.centre, self.radius)
        score = scorer(self.vectors, queries)
        for i, (q, bound, least) in enumerate(zip(query_ids, bounds, floor, strict=True)):
            ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            kth, todo = int(least), [(bound[0], 0)]
            while todo:
                top, at = todo.pop()
                if top < kth:
                    continue
                child, a, b = self.nodes[at]
                if child:
                    todo += sorted((bound[c], c) for c in (child, child + 1) if bound[c] >= kth)  # the better one on top
                    continue
                own = score(a, b, i)
                keep = (own >= kth) & (self.ids[a:b] != q)
                if keep.any():
                    ids, scores = np.concatenate([ids, self.ids[a:b][keep]]), np.concatenate([scores, own[keep]])
                    best = np.lexsort((ids, ~scores))[:k]
                    ids, scores = ids[best], scores[best]
                    if len(ids) == k:
                        kth = max(kth, int(scores[-1]))
            yield q, ids, scores


def upper_bounds(queries: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No inner product of a query with a vector in the ball is greater; the rounding of the floats is added."""
    q = queries.astype(np.float64)
    reach = np.sqrt((q**2).sum(axis=1))[:, None]
    far = np.sqrt((centre**2).sum(axis=1)) + radius
    return q @ centre.T + reach * radius + reach * far * 1e-9 + 1


def scorer(vectors: np.ndarray, queries: np.ndarray):
    """Exact inner products of rows [a, b) with query i: in floats where they can't round, else in longs, else in whole numbers of any size. Raises
    if a product doesn't fit a long."""
    most = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * vectors.shape[1]
    if most < 2.0**53:
        real, asked = vectors.astype(np.float64), queries.astype(np.float64)
        return lambda a, b, i: (real[a:b] @ asked[i]).astype(np.int64)
    if most < 2.0**62:
        return lambda a, b, i: vectors[a:b] @ queries[i]

    def big(a: int, b: int, i: int) -> np.ndarray:
        exact = [sum(int(x) * int(y) for x, y in zip(v, queries[i], strict=True)) for v in vectors[a:b]]
        if any(abs(x) >= 1 << 63 for x in exact):
            raise OverflowError("an inner product does not fit a long")
        return np.array(exact, np.int64)

    return big


# -- shards of near vectors --------------------------------------------------------------------


class Cells:
    """Planes between two far points of a bounded sample, level by level; they deal all vectors into cells of near ones."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.planes: dict[int, tuple[np.ndarray, float]] = {}
        self.width = sample.shape[1] if len(sample) else 0
        todo = [(1, sample.astype(np.float64))]
        while todo and len(self.planes) + 1 < cells:
            at, own = todo.pop(0)
            if len(own) < 2:
                continue
            one = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            way = own[np.argmax(((own - one) ** 2).sum(axis=1))] - one
            along = own @ way
            cut = float(np.median(along))
            if (along >= cut).all():
                continue
            self.planes[at] = way, cut
            todo += [(2 * at, own[along < cut]), (2 * at + 1, own[along >= cut])]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        at, todo = np.ones(len(vectors), np.int64), [1]
        while todo:
            node = todo.pop()
            if node in self.planes:
                own = np.flatnonzero(at == node)
                way, cut = self.planes[node]
                at[own] = 2 * node + (vectors[own] @ way >= cut)
                todo += [2 * node, 2 * node + 1]
        return at


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            cell = -sizes.astype(np.int64)  # other widths are cells of their own
            same = np.flatnonzero(sizes == cells.width)
            if len(same):
                cell[same] = cells(v.take(pa.array(same)).flatten().to_numpy().reshape(len(same), -1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(cell)], ["vec_id", "v", "cell"])

    return run


def _grown(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = BallTree.grow(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_list()).astype(np.int64))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "width": [tree.vectors.shape[1]], **tree.columns()})


BLOCK = "block long, width int, q_ids binary, q_vectors binary, floor binary, middle binary, reach double, longest double, need double"


def _blocked(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block of queries of one width, with the kth score so far of each; and a ball around them, and the least score that one of them needs."""
    m, floor = np.stack(pdf["v"].to_list()).astype(np.int64), pdf["floor"].to_numpy(np.int64)
    real = m.astype(np.float64)
    middle = real.mean(axis=0)
    ball = {"middle": [middle.tobytes()], "reach": [float(np.sqrt(((real - middle) ** 2).sum(axis=1).max()))], "longest": [float(np.sqrt((real**2).sum(axis=1).max()))], "need": [float(floor.min())]}
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "width": [m.shape[1]], "q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q_vectors": [m.tobytes()], "floor": [floor.tobytes()], **ball})


def _balls(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The named columns of about ``BALLS_A_ROW`` shards or blocks of one width in one row, as arrays of numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {name: [b"".join(pdf[c]) if isinstance(pdf[c].iloc[0], bytes) else pdf[c].to_numpy(float).tobytes()] for c, name in columns.items()}
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "width": [pdf["width"].iloc[0]], key: [pdf[key].to_numpy(np.int64).tobytes()], **made})

    rows = max(1, -(-df.count() // BALLS_A_ROW))
    own = df.select(key, "width", *columns, F.pmod(F.xxhash64(key), F.lit(rows)).cast("int").alias("row"))
    return own.groupBy("row", "width").applyInPandas(run, f"row int, width int, {key} binary, {', '.join(f'{name} binary' for name in columns.values())}")


def _query_rows(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.q_ids, np.int64)
    return ids, np.frombuffer(row.q_vectors, np.int64).reshape(len(ids), -1), np.frombuffer(row.floor, np.int64)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, shard, bound) of the shards that may hold a better score for some query of the block: no product of a vector in one ball with one in the other
    exceeds the middles' product by more than each reach times the other's length."""
    for batch in batches:
        for row in batch.to_pylist():
            blocks, shards = np.frombuffer(row["block"], np.int64), np.frombuffer(row["shard"], np.int64)
            m, reach, longest, need, c, radius = (np.frombuffer(row[x]) for x in ("m", "reach", "longest", "need", "c", "radius"))
            m, c = m.reshape(len(blocks), -1), c.reshape(len(shards), -1)
            far = np.sqrt((c**2).sum(axis=1))
            bounds = m @ c.T + reach[:, None] * far + longest[:, None] * radius + longest[:, None] * (far + radius) * 1e-9 + 1
            i, j = np.nonzero(bounds >= need[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(blocks[i]), pa.array(shards[j]), pa.array(bounds[i, j])], ["block", "shard", "bound"])


def _searched(k: int):
    def run(trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """A shard's tree is unpacked once for all the blocks that meet it here."""
        out = []
        for tree in trees.to_dict("records"):
            own = BallTree.of(tree)
            for block in blocks.itertuples():
                out += [(np.full(len(v), q), v, s) for q, v, s in own.search(*_query_rows(block), k)]
        columns = [np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


# -- all shards --------------------------------------------------------------------------------


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product, for each row of ``queries``.

    Both hold ``vec_id`` and ``v`` (array of whole numbers). A query's own id is no hit; ties go to the
    smaller id; a query whose width no vector has gets no rows. All vectors that repeat an id are candidates; of queries that repeat an id, the one with the least
    vector asks. Returns query_id, rank, vec_id, score. Scores are exact; one that a long can't hold raises. Empty tables give no rows.

    Vectors are dealt into cells by planes fitted to a sample of at most ``SAMPLE``, and cells into shards of about 4,096, so that a shard holds near vectors and
    a cell of many equal ones is no hot group. Each shard is a ball tree, grown once. Blocks of near queries meet shards in rounds, by descending bound of the
    shards' root balls: first the best one, then eight, then all others. The kth score that a query has after a round goes into the next one, where it first drops
    whole pairs of block and shard, by the balls around both, before any vector moves, and then prunes nodes and leaves. A shard's tree moves once for every
    ``BLOCKS_A_TASK`` blocks that meet it, and is unpacked once for them.
    """
    spark = vectors.sparkSession
    widths = vectors.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n = vectors.count()
    sample = vectors.where(F.size("v") == widths[0]["w"]).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").toPandas()["v"]
    cells = spark.sparkContext.broadcast(Cells(np.stack(sample.to_list()), min(SAMPLE // 8, max(1, -(-n // VECTORS_A_SHARD)))))
    dealt = lambda df: df.select("vec_id", "v").mapInArrow(_dealt(cells), "vec_id long, v array<long>, cell long")

    def numbered(df: DataFrame, size: int, name: str) -> DataFrame:
        """Groups of about ``size`` rows of one cell, dealt by hash; there are at most ``SAMPLE / 8`` cells, and one for each further width."""
        df = stash(dealt(df))
        parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("parts"))
        return df.join(F.broadcast(parts), "cell").withColumn(name, F.xxhash64("cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))))

    forest = stash(numbered(vectors, VECTORS_A_SHARD, "shard").groupBy("shard", F.size("v")).applyInPandas(_grown, TREE))
    first = lambda c, size: F.expr(f"substring({c}, 1, {size})")
    heads = forest.select("shard", "width", first("centre", "8 * width").alias("centre"), first("radius", 8).alias("radius"))
    roots = stash(_balls(heads, "shard", {"centre": "c", "radius": "radius"}))
    rows_of_roots = roots.agg(F.max("row")).first()[0]

    asked = stash(numbered(queries.groupBy("vec_id").agg(F.min("v").alias("v")), QUERIES_A_BLOCK, "block").select("vec_id", "v", "block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits, done = None, None
    for take in ROUNDS:
        if hits is None:
            known = asked.withColumn("floor", F.lit(-(1 << 63)))
        else:
            kth = hits.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
            known = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-(1 << 63))))
        blocks = stash(known.groupBy("block", F.size("v")).applyInPandas(_blocked, BLOCK))
        balls = _balls(blocks, "block", {"middle": "m", "reach": "reach", "longest": "longest", "need": "need"}).drop("row")
        pairs = balls.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows_of_roots)))).join(roots, ["row", "width"]).drop("row", "width").mapInArrow(_bounded, "block long, shard long, bound double")
        if done is not None:
            pairs = pairs.join(done, ["block", "shard"], "left_anti")
        if take is not None:
            best = Window.partitionBy("block").orderBy(F.desc("bound"), "shard")
            pairs = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= take)
        pairs = stash(pairs.select("block", "shard"))
        # a tree moves once for every BLOCKS_A_TASK blocks that meet it
        parts = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCKS_A_TASK)).cast("int").alias("parts"))
        left = forest.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = pairs.join(parts, "shard").join(blocks.select("block", "q_ids", "q_vectors", "floor"), "block").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).drop("parts")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from the pairs
        found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(_searched(k), HITS)
        every = found if hits is None else hits.unionByName(found)
        hits = stash(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").drop("rank"))
        done = pairs if done is None else done.unionByName(pairs)
    return hits.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``floor(scale * x)`` of each component. Rows with a null id, a null or empty vector, or a null or non-finite component take no part. A component whose
    whole number a long can't hold raises."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    whole = lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component does not fit a long")).cast("long"))
    good = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & sound)
    return good.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
