"""Near duplicates: ProbMinHash signatures of word shingles, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text_arrays as ta
from .shared import NO_ID, hot_keys, join_group_stats, salted_join, stash

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
ROUNDS, PIVOTS = 2, 6
PACK_SHINGLES = 100_000

# -- shingles and signatures -------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct runs of ``size`` words of each row, sorted by row and hash.

    Words are split at white space, with A-Z in lower case; a row with fewer words is one shingle.
    """
    low = ta.LOWER[data]
    a, b, row = ta.words(low, offsets)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ta.span_hash(low, a, b, 8)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    at = np.arange(len(word))
    last = np.minimum(at + size, (first + n)[row])
    starts = (at + size <= (first + n)[row]) | (at == first[row])
    at, last, row = at[starts], last[starts], row[starts]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = at + k < last
            h = np.where(inside, ta.mix(h * np.uint64(3) + word[np.minimum(at + k, len(word) - 1)]), h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    edge = np.flatnonzero(new)
    return row[edge], h[edge], np.diff(np.append(edge, len(h)))


def prob_min_hash(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures that agree in a place with the chance of the rows' probability Jaccard similarity.

    Each item is a Poisson process whose rate is its weight: arrivals come after exponential waits and each goes to a
    random place of the signature, which keeps the item with its earliest arrival. An item stops once
    its next arrival is later than all places of its row; waits and places are functions of the item, not of the row.
    """
    first, sign = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    time = np.zeros(len(item))
    k = 0
    while len(item):
        k += 1
        with np.errstate(over="ignore"):
            r = ta.mix(item + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / weight
        place = row * size + (ta.mix(r) % np.uint64(size)).astype(np.int64)
        before = first[place]
        np.minimum.at(first, place, time)
        hit = (time == first[place]) & (time < before)
        sign[place[hit]] = item[hit]
        edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        live = time < np.repeat(first.reshape(n, size)[row[edge]].max(axis=1), np.diff(np.append(edge, len(row))))
        row, item, weight, time = row[live], item[live], weight[live], time[live]
    return sign.reshape(n, size)


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                row, item, _ = shingles(*ta.raw(part.column("text")), size)
                n = part.num_rows
                # links are defined on sets: with weight 1 for each shingle two places agree with the sets' Jaccard similarity
                sign = prob_min_hash(row, item, np.ones(len(item)), n, bands * rows)
                key = np.zeros((n, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(rows):
                        key = ta.mix(key * np.uint64(5) + sign[:, k::rows] + np.uint64(k))
                    key = ta.mix(key + np.arange(bands, dtype=np.uint64))  # bands share no key
                    # two sums over the set of shingles: rows with one set are one text to this operator
                    edges = np.searchsorted(row, np.arange(n + 1))
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(item ^ np.uint64(s)), dtype=np.uint64)]) for s in (101, 202)]
                    sets = np.stack([s[edges[1:]] - s[edges[:-1]] for s in sums], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(key.view(np.int64).ravel()))
                nodes = pa.array([x.tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copy"), nodes, pa.array(np.diff(edges)), lists], ["id", "copy", "node", "n", "keys"])

    return run


def _verified(size: int, least: float):
    """Pairs whose sets of shingles have a Jaccard similarity of ``least`` or more, from both texts; all columns but the texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text_b"):
                one, other = (shingles(*ta.raw(part.column(c)), size)[:2] for c in ("text_a", "text_b"))
                n = part.num_rows
                keys = [ta.mix(h ^ ta.mix(r.astype(np.uint64))) for r, h in (one, other)]
                both = np.isin(keys[0], keys[1], assume_unique=True)
                shared = np.bincount(one[0][both], minlength=n)
                union = np.bincount(one[0], minlength=n) + np.bincount(other[0], minlength=n) - shared
                yield part.drop_columns(["text_a", "text_b"]).filter(pa.array(shared >= least * union - 1e-9))

    return run


def _overlap(one: list[np.ndarray], other: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Shared items of each pair of two lists of sets: products of 0/1 tables, ``width`` items at a time."""
    out = np.zeros((len(one), len(other)), np.int64)
    sides = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (one, other)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    found = []
    for item, row in sides:
        both = ta.among(item, common)
        column, row = np.searchsorted(common, item[both]), row[both]
        order = np.argsort(column, kind="stable")
        found.append((column[order], row[order]))
    for start in range(0, len(common), width):
        tables = []
        for (column, row), n in zip(found, (len(one), len(other)), strict=True):
            a, b = np.searchsorted(column, [start, start + width])
            table = np.zeros((n, min(width, len(common) - start)), np.float32)
            table[row[a:b], column[a:b] - start] = 1
            tables.append(table)
        out += (tables[0] @ tables[1].T).astype(np.int64)
    return out


def _linked(size: int, least: float):
    """Links between two packs of one bucket, as pairs of components. Shared shingles of all pairs of nodes in different components
    are counted; two components that one link has joined need no second."""

    def side(x: pa.StructArray) -> tuple:
        root = x.field("root").to_numpy()
        row, item, _ = shingles(*ta.raw(x.field("text")), size)
        return root, np.split(item, np.searchsorted(row, np.arange(1, len(root))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (g1, t1), (g2, t2) = (side(batch.column(c)[i].values) for c in "ab")
                m1, m2 = (np.array([len(t) for t in items]) for items in (t1, t2))
                # sets of sizes further apart than the similarity can't have it
                open_ = (g1[:, None] != g2[None]) & (np.minimum(m1[:, None], m2[None]) >= least * np.maximum(m1[:, None], m2[None]) - 1e-9)
                x, y = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                links = np.zeros((0, 2), np.int64)
                if len(x):
                    both = _overlap([t1[j] for j in x], [t2[k] for k in y])
                    near = open_[np.ix_(x, y)] & (both >= least * (m1[x][:, None] + m2[y][None] - both) - 1e-9)
                    j, k = np.nonzero(near)
                    links = np.unique(np.stack([g1[x[j]], g2[y[k]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


# -- classes -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Label of each node that has an edge: the least node it is connected to. Edges are (a, b).

    Alternates large-star and small-star steps, each written to the shared folder, until a step changes nothing; the number of
    steps grows with the logarithm of the longest path.
    """
    now = stash(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state
        # large star: what is larger than a node goes to the least of the node and its neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = join_group_stats(both, least, ["u"], "c", 2 * state[0], "inner").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        ends = F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))
        now = stash(large.join(small, "v").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct())


def _verify(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b, and other columns) whose texts are near. Many pairs may share one ``b``: their rows are spread."""
    hot = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), ["b"], "c", max(1, pairs.count()))
    one = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    both = salted_join(one, texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), ["b"], hot)
    return both.select(*pairs.columns, "text_a", "text_b").mapInArrow(_verified(size, least), pairs.schema)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots (v, root) after components that are linked (a, b) have become one."""
    new = components(links).select(F.col("node").alias("root"), F.col("root").alias("new"))
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("c"))
    joined = salted_join(roots, new, ["root"], hot_keys(sizes, ["root"], "c", max(1, roots.count())), "left")
    return stash(joined.select("v", F.coalesce("new", "root").alias("root")))


def _still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, v) of buckets that hold several components, with their roots."""
    placed = stash(members.select("key", "v").join(roots, "v"))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("key", "c")
    return stash(join_group_stats(placed, stash(split), ["key"], "c", max(1, placed.count()), "inner"))


def _pivot_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member of an open bucket with those of ``PIVOTS`` nodes of the bucket that lie in other components."""
    picks = [F.min(F.struct(F.xxhash64("v", F.lit(turn * PIVOTS + k)).alias("h"), F.col("v").alias("b"), F.col("root").alias("rb"))) for k in range(PIVOTS)]
    pivots = stash(members.groupBy("key").agg(F.array(*picks).alias("picks"), F.count(F.lit(1)).alias("n")))
    total = max(1, members.count())
    pairs = salted_join(members, pivots, ["key"], hot_keys(pivots, ["key"], "n", total)).select("v", "root", F.explode("picks").alias("p")).where("root <> p.rb")
    return stash(pairs.select(F.col("v").alias("a"), F.col("p.b").alias("b"), F.col("root").alias("ra"), F.col("p.rb").alias("rb")).distinct())


def _pack_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Links (a, b) between components that still share a bucket, from all pairs of nodes in different ones.

    In each bucket the largest component is compared with the others only, these also with each other. Nodes are packed by hash, about
    ``PACK_SHINGLES`` shingles to a pack; each pair of packs is a row of its own (bucket, pack, pack), so that large buckets are spread.
    """
    sized = stash(members.select("key", "v", "root").join(nodes.select("v", "n"), "v"))
    roots = sized.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    pack_count = lambda s: F.greatest(F.lit(1), F.ceil(s / F.lit(float(PACK_SHINGLES))))
    buckets = roots.groupBy("key").agg(F.max(F.struct("c", "root", "s")).alias("main"), F.sum("s").alias("s"), F.sum("c").alias("c"))
    buckets = stash(buckets.select("key", "c", F.col("main.root").alias("main"), pack_count(F.col("s") - F.col("main.s")).alias("others"), pack_count(F.col("main.s")).alias("mains")))
    marked = join_group_stats(sized, buckets, ["key"], "c", max(1, sized.count()), "inner")
    # the packs of the other components come first: 0 .. others - 1
    h, is_main = F.xxhash64("v", F.lit(7)), F.col("root") == F.col("main")
    marked = marked.withColumn("pack", F.when(is_main, F.col("others") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("others"))))
    packs = marked.join(texts, "v").groupBy("key", "pack").agg(F.collect_list(F.struct("root", "text")).alias("x"), F.any_value("others").alias("others"), F.any_value("mains").alias("mains"))
    packs = stash(packs)
    sides = packs.where("pack < others").select("key", F.col("x").alias("a"), F.explode(F.sequence(F.col("pack"), F.col("others") + F.col("mains") - 1)).alias("pack"))
    return stash(sides.join(packs.select("key", "pack", F.col("x").alias("b")), ["key", "pack"]).select("a", "b").mapInArrow(_linked(size, least), "a long, b long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near duplicates: one row per input row with ``id_col``, ``text_hash``, ``class_id``, ``class_size``, ``kept``.

    Two texts are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``least`` or more; classes are the
    connected components, named by their smallest id, whose row is kept (of repeated rows, one).

    1. Rows with one set of shingles become one node; rows without words are classes of their own. Signatures weigh each distinct
       shingle 1, however often a text repeats it, so that they estimate the similarity that is verified; two sets of similarity 0.8 meet in
       no band with a chance of 7e-5.
    2. Nodes that agree in a band meet in a bucket and are compared with the bucket's least node, then, where a bucket
       still holds several components, with six further nodes of it in each of two rounds. A bucket with thousands of near copies so
       becomes one component at a cost in proportion to its nodes.
    3. What is left are pairs of one bucket in different components. All of them are compared inside tasks, pack by pack, by counting the
       shingles that they share. Only links leave the task, and no two classes that a link between texts of one bucket joins stay apart.
    A very long text is one node like others: its shingles are hashed in one pass, and compared in lists of its own length.
    Candidates carry node numbers only; texts are joined to the pairs at the end, and hot keys of every join are spread. A null id is the largest
    id; a null text has no words; columns other than the two named are not read, whatever their names; an empty table gives no rows.
    """
    ids = F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(ids.alias("id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    signed = stash(docs.mapInArrow(_signed(bands, rows, size), "id long, copy long, node binary, n long, keys array<long>").withColumn("row", F.monotonically_increasing_id()))
    some = signed.where("n > 0")
    total = max(1, some.count())

    nodes = some.groupBy("node").agg(F.min(F.struct("id", "copy", "row")).alias("first"), F.count(F.lit(1)).alias("size"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    nodes = stash(nodes.withColumn("v", F.monotonically_increasing_id()))
    keyed = nodes.select("v", F.explode("keys").alias("key"))
    buckets = stash(keyed.groupBy("key").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = stash(join_group_stats(keyed, buckets, ["key"], "members", total * bands, "inner"))

    # one text for each node that meets another: its first row
    wanted = nodes.select("v", F.col("first.id").alias("id"), F.col("first.copy").alias("copy")).join(met.select("v").distinct(), "v", "left_semi")
    texts = stash(docs.join(wanted, ["id", "copy"]).select("v", "text").dropDuplicates(["v"]))
    near = stash(met.where("v <> least").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct())
    links = components(stash(_verify(near, texts, size, least)))
    roots = stash(texts.select("v").join(links.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("root", "v").alias("root")))

    members = _still_open(met, roots)
    for turn in range(ROUNDS):
        if members.isEmpty():
            break
        linked = stash(_verify(_pivot_pairs(members, turn), texts, size, least).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        roots = _merged(roots, linked)
        members = _still_open(members, roots)
    if not members.isEmpty():
        roots = _merged(roots, _pack_links(members, nodes, texts, size, least).distinct())

    named = stash(nodes.select("v", "node", "first", "size").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    classes = stash(named.groupBy("root").agg(F.min("first").alias("head"), F.sum("size").alias("class_size"), F.count(F.lit(1)).alias("parts")))
    placed = stash(join_group_stats(named.select("node", "root", "size"), classes, ["root"], "parts", total).select("node", "head", "class_size", "size"))
    out = join_group_stats(some.select("node", "id", "copy", "row"), placed, ["node"], "size", total)
    out = out.select("id", "copy", F.col("head.id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))
    alone = signed.where("n = 0").select("id", "copy", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.unionByName(alone).select(real("id").alias(id_col), F.col("copy").alias("text_hash"), real("class_id").alias("class_id"), "class_size", "kept")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")
