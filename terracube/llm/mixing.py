"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracube.operators.grid import dense_index

from . import text_arrays as ta
from .apportion import sainte_lague
from .shared import NO_ID, free_name, stash

BLOCK = 32
MOST_TIMES = 3
DOCS_A_SHARD = 500
MOST_SHARDS = 1 << 16
MOST_SOURCES = 100_000
PRICES = 64

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_TIMES) -> np.ndarray:
    """Share the sum of ``sizes`` by weight; no share is above ``most`` times its size, the excess is shared anew."""
    sizes, weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, free = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    total = sizes.sum()
    while free.any():
        left = total - (most * sizes[~free]).sum()
        share = left * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            out[free] = share[free]
            break
        free &= ~over
    out[~free] = most * sizes[~free]
    return out


def _quotas(block: int):
    """Blocks of one source for each of its shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard", kind="stable")
        return pdf.assign(_quota=sainte_lague(pdf["_words"].to_numpy(), int(pdf["_blocks"].iloc[0])))

    return run


def _take(block: int, most: int, seed: int):
    """Words taken of each document of one source's shard, and which runs of its words beside whole passes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "_tie"], kind="stable", na_position="last")
        size = pdf["size"].to_numpy(np.int64)
        length, shard = int(size.sum()), int(pdf["_shard"].iloc[0])
        wanted = min(int(pdf["_quota"].iloc[0]) * block, most * length)
        times, rest = divmod(wanted, length) if length else (0, 0)
        edges = np.append(np.arange(0, length, block), length)
        sizes = np.diff(edges)
        order = np.argsort(ta.mix(np.arange(len(sizes), dtype=np.uint64) ^ ta.mix(np.uint64(seed * 1_000_003 + shard))), kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        chosen = np.zeros(len(sizes), bool)
        chosen[order[before + sizes[order] / 2 <= rest]] = True  # a block is taken whole: the sum ends within half a block
        gained = np.concatenate([[0], np.cumsum(np.where(chosen, sizes, 0))])

        def upto(x: np.ndarray) -> np.ndarray:
            b = np.minimum(x // block, len(sizes) - 1) if len(sizes) else np.zeros(len(x), np.int64)
            return gained[b] + np.where(chosen[b], x - edges[b], 0) if len(sizes) else np.zeros(len(x), np.int64)

        end = np.cumsum(size)
        pdf["taken"] = times * size + upto(end) - upto(end - size)
        # runs of chosen blocks, cut at the documents' edges and counted from a document's first word
        step = np.diff(np.concatenate([[0], chosen.astype(np.int8), [0]]))
        lo, hi = edges[np.flatnonzero(step == 1)], edges[np.flatnonzero(step == -1)]
        a, b = np.searchsorted(hi, end - size, "right"), np.searchsorted(lo, end, "left")
        n = np.where(size > 0, b - a, 0)
        doc = np.repeat(np.arange(len(size)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n - a, n)
        begin = (end - size)[doc]
        pairs = np.stack([np.maximum(lo[at], begin) - begin, np.minimum(hi[at], end[doc]) - begin], axis=1).ravel()
        pdf["spans"] = pd.Series([x.tolist() for x in np.split(pairs, 2 * np.cumsum(n)[:-1])], index=pdf.index, dtype=object)
        return pdf

    return run


def _plan_here(by_source: DataFrame, weights: Sequence[float], block: int, most: int) -> DataFrame:
    """Target and blocks of each source, reckoned in the driver: for at most ``MOST_SOURCES`` of them."""
    found = sorted(by_source.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = np.array([r["source_size"] for r in found], np.int64)
    goal = targets(sizes, np.array([weights[i % len(weights)] for i in range(len(found))]), most) if found else np.zeros(0)
    blocks = sainte_lague(goal, round(goal.sum() / block)) if found else np.zeros(0, np.int64)
    rows = [(r["source"], int(s), r["_docs"], float(g), int(b)) for r, s, g, b in zip(found, sizes, goal, blocks, strict=True)]
    return by_source.sparkSession.createDataFrame(rows, "source string, source_size long, _docs long, target double, _blocks long")


def _plan_spread(by_source: DataFrame, weights: Sequence[float], block: int, most: int) -> DataFrame:
    """The same for any number of sources, by sums over their table: a level that shares what capped sources leave, then the price of the last block."""
    named = dense_index(by_source, "source", "i")
    rank = by_source.join(named, "source", "left").withColumn("i", F.coalesce("i", F.lit(named.count())))  # null comes last
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    rows = stash(rank.withColumn("w", weight))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, free = 0.0, None
    while True:  # a source once capped stays so: the level only rises
        capped = F.lit(level) * F.col("w") > F.col("source_size") * most
        got = rows.agg(F.sum(F.when(capped, F.col("source_size") * most).otherwise(0)).alias("c"), F.sum(F.when(~capped, F.col("w")).otherwise(0.0)).alias("w"), F.count_if(~capped).alias("free")).first()
        if got["free"] == free or not got["free"]:
            break
        free, level = got["free"], (total - got["c"]) / got["w"]
    rows = rows.withColumn("target", F.least(F.lit(level) * F.col("w"), (F.col("source_size") * most).cast("double")))
    seats = round((rows.agg(F.sum("target")).first()[0] or 0.0) / block)

    def at(price: float) -> Column:
        """Blocks that cost at most ``price``, where block j of a source costs (2 j + 1) / target."""
        return F.floor((F.lit(float(price)) * F.col("target") + 1) / 2).cast("long")

    low, high = 0.0, 4.0 * max(1, seats) / max(total, 1) + 4.0 / max(1.0, rows.agg(F.min(F.when(F.col("target") > 0, F.col("target")))).first()[0] or 1.0)
    while np.nextafter(low, np.inf) < high:
        steps = np.unique(np.linspace(low, high, PRICES))
        sums = rows.agg(*[F.sum(at(p)).alias(f"s{k}") for k, p in enumerate(steps)]).first()
        over = [k for k in range(len(steps)) if (sums[k] or 0) > seats]
        below, above = (steps[over[0] - 1], steps[over[0]]) if over and over[0] else (steps[-1], high) if not over else (0.0, steps[0])
        if (below, above) == (low, high) or not over:
            low = below
            break
        low, high = float(below), float(above)
    rows = stash(rows.withColumns({"_blocks": at(low), "_more": (at(high) > at(low)).cast("int")}))
    short = seats - (rows.agg(F.sum("_blocks")).first()[0] or 0)
    last = rows.where("_more = 1").orderBy("i").limit(int(max(0, short))).select("i", F.lit(1).alias("_one"))  # ties go to the lower index
    out = rows.join(last, "i", "left")
    return out.select("source", "source_size", "_docs", "target", (F.col("_blocks") + F.coalesce("_one", F.lit(0))).alias("_blocks"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), block: int = BLOCK, most: int = MOST_TIMES, seed: int = 7) -> DataFrame:
    """How many words of each document a weighted mix takes; one row per input row.

    Returns ``doc_id``, ``source``, ``text_hash``, ``size`` (words), ``source_size``, ``target`` (words
    of its source), ``taken`` (words with repeats) and ``spans``: the runs of words of the chosen blocks, beside whole passes,
    as first word and end in turn. Sources in code-point order, null last, weigh
    ``weights`` in turn. The mix is cut into blocks of ``block`` words: first the sources, then within
    each source its shards get integer quotas by highest quotients, and each shard takes whole passes
    over its words and, for the rest, blocks in a seeded order.

    Null and empty texts have size 0 and are not taken. A null source is a source of its own. Repeated
    rows count each; a very long text may be taken in part. Only ids and word counts are dealt out; a source is spread over shards of about
    500 documents, so that a large one is no hot group. Up to 100,000 sources are apportioned in the driver; more of them by sums over their table, with
    the same result but for the rounding of floats. Columns that are not named are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stash(df.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    by_source = stash(by_source)
    few = by_source.count() <= MOST_SOURCES
    plan = _plan_here(by_source, weights, block, most) if few else stash(_plan_spread(by_source, weights, block, most))
    known = (F.broadcast if few else (lambda x: x))(plan.select(F.col("source").alias("_s"), "source_size", "target", "_blocks", F.least(F.lit(MOST_SHARDS), F.ceil(F.col("_docs") / DOCS_A_SHARD)).alias("_shards")))

    sized = sized.join(known.select("_s", "_shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sized = sized.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("_shards")).cast("int")).drop("_shards")
    by_shard = sized.groupBy("source", "_shard").agg(F.sum("size").alias("_words"))
    by_shard = by_shard.join(known.drop("_shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = by_shard.groupBy("source").applyInPandas(_quotas(block), "source string, _shard int, _words long, source_size long, target double, _blocks long, _quota long")
    # a shard's quota and its documents meet in one group of about 500 small rows
    both = sized.withColumn("_tie", F.col("text_hash")).join(quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), "source_size", "target", "_quota"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).drop("_s", "_h")
    out = "doc_id long, source string, text_hash long, size long, _shard int, _tie long, source_size long, target double, _quota long, taken long, spans array<long>"
    return both.groupBy("source", "_shard").applyInPandas(_take(block, most, seed), out).drop("_shard", "_tie", "_quota").withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _repeated(text_col: str, names: list[str], own: list[str]):
    """Whole copies of a text, and for the rest the runs of its words that were chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, text_col):
                rows, texts = [], []
                for i, (text, size, taken, spans) in enumerate(zip(*(part.column(c).to_pylist() for c in (text_col, *own)), strict=True)):
                    times, rest = divmod(taken, size)
                    made = [text] * times
                    if rest:
                        words = [m.span() for m in _WORD.finditer(text)]
                        made += [text[words[a][0] : words[b - 1][1]] for a, b in zip(spans[::2], spans[1::2], strict=True)]
                    rows += [i] * len(made)
                    texts += made
                columns = [pa.array(texts, pa.string()) if c == text_col else part.column(c).take(pa.array(rows, pa.int64())) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows that the mix of ``mix_sources`` takes, with the columns of ``df``: a row for each whole pass over a text, and
    one for each run of its words in the chosen blocks. Rows that repeat an id with its text share one decision."""
    key, text_key, *own = (free_name(df, c) for c in ("_id", "_hash", "_size", "_taken", "_spans"))
    plan = mix_sources(df, id_col, text_col, source_col, **options).where("taken > 0")
    plan = plan.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(key), F.col("text_hash").alias(text_key), *[F.col(c).alias(n) for c, n in zip(("size", "taken", "spans"), own, strict=True)]).dropDuplicates([key, text_key])
    keyed = df.withColumns({key: F.coalesce(F.col(id_col), F.lit(NO_ID)).cast("long"), text_key: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return keyed.join(plan, [key, text_key]).select(*df.columns, *own).mapInArrow(_repeated(text_col, df.columns, own), df.schema)
