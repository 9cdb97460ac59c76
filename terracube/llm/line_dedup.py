"""Line dedup over a sharded minimal perfect hash.

Distinct keys of repeated lines are dealt into shards. Each shard becomes a minimal perfect hash
(levels of bit arrays: a key takes a bit that no other key of its level wants, the rest go on to
the next level, and the rank of its bit is its slot) with arrays of fingerprints, document counts and first documents.
Documents send line hashes to the shards and probe the arrays; lines are never joined to lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .shared import NO_ID, free_name, stash

MIN_POINTS = 10
LINES_A_SHARD = 20_000
HOT_SHARE = 10_000
PARTS_OF_NO_ID = 4_096
COUNTS = ("n_lines", "n_dropped")

INDEX = "shard int, levels array<int>, bits binary, fingerprints binary, counts binary, owners binary"
PROBES = "shard int, doc long, part int, h1 long, h2 long"


# -- one shard ---------------------------------------------------------------------------------


def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (ta.mix(h.view(np.uint64) + np.uint64(level * 0x9E37 + 1)) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct 64-bit keys."""
    sizes, bits, left = [], [], keys
    while len(left):
        size = max(8, int(1.5 * len(left)))
        at = _slot(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def look_up(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Slot of each key; keys outside the set get an arbitrary slot or -1, which the fingerprint tells."""
    out = np.full(len(keys), -1, np.int64)
    todo, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _slot(keys[todo], level, size)
        hit = bits[at]
        out[todo[hit]] = ranks[at[hit]]
        todo, base = todo[~hit], base + size
    return out


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _key(pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64))
    sizes, bits = build_hash(keys)
    slot = look_up(keys, sizes, bits, np.cumsum(bits) - 1)
    arrays = {}
    for name, kind in (("h2", np.int64), ("n", np.int64), ("owner", np.int64)):
        arrays[name] = np.zeros(len(slot), kind)
        arrays[name][slot] = pdf[name].to_numpy(kind)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "levels": [sizes], "bits": [np.packbits(bits).tobytes()], "fingerprints": [arrays["h2"].tobytes()], "counts": [arrays["n"].tobytes()], "owners": [arrays["owner"].tobytes()]})


def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) ^ ta.mix(h2.view(np.uint64))).view(np.int64)


class Shard:
    def __init__(self, levels: list[int], bits: bytes, fingerprints: bytes, owners: bytes):
        self.sizes = [int(x) for x in levels]
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8))[: sum(self.sizes)].astype(bool)
        self.ranks = np.cumsum(self.bits) - 1
        self.fingerprints, self.owners = np.frombuffer(fingerprints, np.int64), np.frombuffer(owners, np.int64)

    @classmethod
    def of(cls, row: dict) -> Shard:
        return cls(row["levels"], row["bits"], row["fingerprints"], row["owners"])

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        slot = look_up(_key(h1, h2), self.sizes, self.bits, self.ranks)
        return (slot >= 0) & (self.fingerprints[slot] == h2)

    def drops(self, doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Is this line a repeated one that another document holds first?"""
        slot = look_up(_key(h1, h2), self.sizes, self.bits, self.ranks)
        return (slot >= 0) & (self.fingerprints[slot] == h2) & (self.owners[slot] != doc)


# -- documents ---------------------------------------------------------------------------------


def _keyed_lines(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, ...]:
    """Start, end, row, both hashes and length in code points of every line of the batch."""
    data, offsets = ta.raw(batch.column(text))
    starts, ends, row = ta.lines(data, offsets)
    a, b = ta.stripped(data, starts, ends)
    low = ta.LOWER[data]
    return starts, ends, row, ta.span_hash(low, a, b, 1).view(np.int64), ta.span_hash(low, a, b, 2).view(np.int64), ta.points(data, a, b)


def _line_hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                _, _, row, h1, h2, n = _keyed_lines(part, "text")
                doc, share = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "part"))
                keep = n >= least
                table = pd.DataFrame({"doc": doc[keep], "part": share[keep], "h1": h1[keep], "h2": h2[keep]}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(table, preserve_index=False)

    return run


def _send(least: int, shards: int, hot_shard):
    """Probes for the shards; a line that a hot key settles carries its verdict as a negative shard number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Shard.of(hot_shard.value) if hot_shard.value else None
        for batch in _line_hashes(least)(batches):
            doc, part, h1, h2 = (batch.column(c).to_numpy() for c in ("doc", "part", "h1", "h2"))
            shard = h1 % shards
            if hot is not None:
                hit = hot.holds(h1, h2)
                drop = hot.drops(doc, h1, h2)
                shard[drop] = -1 - doc[drop] % 10_007
                stay = drop | ~hit
                doc, part, h1, h2, shard = doc[stay], part[stay], h1[stay], h2[stay], shard[stay]
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(doc), pa.array(part), pa.array(h1), pa.array(h2)], ["shard", "doc", "part", "h1", "h2"])

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, its arrays first; only one shard is in memory at a time."""
    now, shard = None, None
    for batch in batches:
        ids = batch.column("shard").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if ids[a] != now:
                now, shard = ids[a], None
            if part.column("levels")[0].is_valid:
                shard = Shard(*(part.column(c)[0].as_py() for c in ("levels", "bits", "fingerprints", "owners")))
                part = part.slice(1)
            if not part.num_rows or (shard is None and now >= 0):
                continue
            doc, h1, h2 = (part.column(c).to_numpy() for c in ("doc", "h1", "h2"))
            drop = shard.drops(doc, h1, h2) if now >= 0 else np.ones(len(doc), bool)
            yield pa.RecordBatch.from_arrays([pa.array(doc[drop]), part.column("part").filter(pa.array(drop)), pa.array(h1[drop])], ["doc", "part", "h1"])


def _rewrite(text_col: str, names: list[str], drops_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, text_col):
                texts, counts, dropped = part.column(text_col).to_pylist(), [], []
                starts, ends, row, h1, _, n = _keyed_lines(part, text_col)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                drops = part.column(drops_col).to_pylist()
                raw, _ = ta.raw(part.column(text_col))
                for i, drop in enumerate(drops):
                    a, b = first[i], first[i + 1]
                    counts.append(b - a)
                    gone = np.isin(h1[a:b], np.array(drop, np.int64)) & (n[a:b] >= 1) if drop else np.zeros(b - a, bool)
                    dropped.append(int(gone.sum()))
                    if dropped[-1]:
                        texts[i] = b"\n".join(raw[s:e].tobytes() for s, e, g in zip(starts[a:b], ends[a:b], gone, strict=True) if not g).decode()
                columns = [pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*names, *COUNTS])

    return run


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_POINTS) -> DataFrame:
    """Drop lines that an earlier document holds; returns all columns with the new text, ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of white space and with A-Z in lower case. A key of ``least`` code
    points or more that occurs in two documents or more keeps its lines in the smallest id only.
    A null text is one empty line and stays null; rows with the same id are one document; null ids count
    as one document with the largest id. A very long text, or line, is read whole and probed line by line like others. Empty tables give empty results; columns
    named like the results are replaced, all others stay, whatever their names.

    Scale: three passes over the texts. Only (hash, hash, id) of lines is dealt out by key; shards of about 20,000 lines grow
    in number with the lines, and one shard's arrays at a time are in a task's memory. A key in more than a 10,000th of
    all lines is hot: there are fewer such keys than that, so they are handed to every task
    and their lines are never sent. Texts move once, to meet the list of their dropped lines; the rows without an id, though one document,
    meet theirs in parts.
    """
    spark = df.sparkSession
    df = df.drop(*COUNTS)
    doc = F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long")
    share = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(F.col(text_col)), F.lit(PARTS_OF_NO_ID))).otherwise(F.lit(0)).cast("int")
    keyed = df.select(doc.alias("doc"), share.alias("part"), F.col(text_col).cast("string").alias("text"))

    seen = Observation()
    keys = keyed.mapInArrow(_line_hashes(least), "doc long, part int, h1 long, h2 long").groupBy("h1", "h2")
    keys = keys.agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = stash(keys.observe(seen, F.sum("n").alias("lines")).where("owner < last").select("h1", "h2", "owner", "n"))
    total = seen.get["lines"] or 0
    shards = max(1, -(-total // LINES_A_SHARD))

    is_hot = F.col("n") * F.lit(min(shards, HOT_SHARE)) > F.lit(total)
    hot = repeated.where(is_hot).select("h1", "h2", "owner", "n").toPandas()  # fewer than HOT_SHARE rows
    hot_shard = spark.sparkContext.broadcast(build_shard(hot.assign(shard=0)).iloc[0].to_dict() if len(hot) else None)
    index = repeated.where(~is_hot).withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    index = index.groupBy("shard").applyInPandas(build_shard, INDEX)

    sent = keyed.mapInArrow(_send(least, shards, hot_shard), PROBES)
    rows = index.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", F.col("levels").isNull())
    d, p, gone = (free_name(df, c) for c in ("_doc", "_part", "_drops"))
    drops = rows.mapInArrow(_probe, "doc long, part int, h1 long").groupBy(F.col("doc").alias(d), F.col("part").alias(p)).agg(F.collect_set("h1").alias(gone))

    joined = df.withColumns({d: doc, p: share}).join(drops, [d, p], "left")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return joined.select(*df.columns, gone).mapInArrow(_rewrite(text_col, df.columns, gone), schema)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, k.owner IS NOT NULL AND k.owner <> l.doc_id AS gone FROM l LEFT JOIN k USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
