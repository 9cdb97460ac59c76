"""Language-model scores by context-tree weighting over bytes, and a unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .shared import stash

DEPTH = 5
MOST_GRAMS = 1 << 20
MOST_WORDS = 1 << 19
GRAMS_A_TASK = 400_000
FOLDS, HELD_OUT = 7, 2
END = 0xFF  # no byte of UTF-8: stands before and after each text

# -- counts ------------------------------------------------------------------------------------


def framed(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with ``depth`` end marks before and one behind each text; places to code and their rows."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    out = np.full(len(data) + n * (depth + 1), END, np.uint8)
    out[np.arange(len(data)) + (row + 1) * depth + row] = ta.LOWER[data]
    rows = np.repeat(np.arange(n), sizes + 1)
    return out, np.arange(len(data) + n) + (rows + 1) * depth, rows


def grams(frame: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Each coded byte with the ``depth`` bytes before it, the latest one in the lowest place."""
    wide = frame.astype(np.uint64)
    whole = wide.copy()
    for k in range(1, depth + 1):
        whole[k:] |= wide[:-k] << np.uint64(8 * k)
    return whole[places]


class _Counter:
    """Counts of 64-bit keys, summed up as they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.loose = 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        found, times = np.unique(keys, return_counts=True)
        self.parts.append((found, times * weight))
        self.size += len(found)
        self.loose += len(found)
        if self.loose > 800_000:
            self.parts = [self.total()]
            self.size, self.loose = len(self.parts[0][0]), 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[edge], np.add.reduceat(times, edge) if len(edge) else times


def _counted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, counter: _Counter) -> Iterator[pa.RecordBatch]:
            keys, n = counter.total()
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], ["kind", "key", "n"])

        counters = [_Counter(), _Counter()]
        for batch in batches:
            for part in ta.slices(batch, "text", ta.SLICE_BYTES // 2):
                held = part.column("held_out").to_numpy(zero_copy_only=False)
                data, offsets = ta.raw(part.column("text"))
                frame, places, rows = framed(data, offsets, depth)
                keys, known = grams(frame, places, depth), ~held[rows]
                counters[0].add(keys[known])
                counters[0].add(keys[~known], 0)  # what only held-out texts hold is priced, too, from no counts
                a, b, row = ta.words(data, offsets)
                counters[1].add(ta.span_hash(ta.LOWER[data], a, b, 9)[~held[row]])
                for kind in (0, 1):
                    if counters[kind].size > 2_000_000:
                        yield from out(kind, counters[kind])
                        counters[kind] = _Counter()
        for kind in (0, 1):
            yield from out(kind, counters[kind])

    return run


def _threshold(df: DataFrame, n: str, most: int) -> int:
    """The least count, in steps of 4 %, such that at most ``most`` rows have that or more."""
    steps = df.where(F.col(n) > 0).groupBy(F.floor(F.log2(n) * 16).alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()  # about 1,000 rows at most
    kept, least = 0, 62 * 16
    for step, rows in sorted(((r["step"], r["rows"]) for r in steps), reverse=True):
        if kept + rows > most:
            break
        kept, least = kept + rows, step
    return int(np.ceil(2 ** (least / 16) - 1e-9))


# -- the tree ----------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


def _sums(starts: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(v, starts) if len(starts) else v[:0] for v in values]


def weigh(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Weight all depths from 2 on, for grams that hold whole subtrees: all grams with the same two latest bytes must be among them.

    A node is a context with one of the eight binary decisions that make up the byte after it and the bits decided before. Its weighted probability is half its own
    Krichevsky-Trofimov block probability and half the product of its longer contexts' weighted ones. Only contexts that occur are nodes.
    Returns, for each gram and decision, the chance of a one as depths 2 and more mix it, and what depth 1 needs: for each decision
    the codes of the nodes of depth 1, their zeros and ones, and the sum of their longer contexts' logarithms.
    """
    symbol = (keys & np.uint64(255)).astype(np.int64)
    context = np.zeros(len(keys), np.uint64)  # the latest byte comes first
    for d in range(depth):
        context |= ((keys >> np.uint64(8 * (d + 1))) & np.uint64(255)) << np.uint64(8 * (depth - 1 - d))
    ones, needs = np.zeros((len(keys), 8), np.float32), []
    for b in range(8):
        node = context | ((symbol >> (8 - b)).astype(np.uint64) << np.uint64(8 * depth))
        order = np.argsort(node)
        node, bit, m = node[order], (symbol[order] >> (7 - b)) & 1, n[order].astype(np.float64)
        levels = []
        for d in range(depth, 1, -1):
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(node))))
            if d == depth:
                zero, one = _sums(starts, m * (1 - bit), m * bit)
                log_p = _estimate(zero, one)
                stop = np.ones(len(starts))
            else:
                zero, one, below = _sums(starts, zero, one, log_p)
                own = _estimate(zero, one)
                log_p = np.logaddexp(own, below) - np.log(2)
                stop = np.exp(own - np.log(2) - log_p)
            levels.append((of, stop, (one + 0.5) / (zero + one + 1)))
            node = node[starts] >> np.uint64(8)
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        first = node[starts].astype(np.int64)  # bits decided before, then the latest byte
        needs.append((codes(first & 255, first >> 8, b), *_sums(starts, zero, one, log_p)))
        gathered, share = np.zeros(len(levels[-1][1])), np.ones(len(levels[-1][1]))
        for of, stop, own in reversed(levels):
            gathered, share = (gathered + share * stop * own)[of], (share * (1 - stop))[of]
        ones[order, b] = gathered
    return ones, needs


def codes(latest: np.ndarray, before: np.ndarray, b: int) -> np.ndarray:
    """A number below 65,536 for each node of depth 1: the latest byte, the number of bits decided before and the bits."""
    return (1 << (8 + b)) | (latest << b) | before


def top_levels(code: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 give to the chance of a one at each node of depth 1, and the share that they leave to longer contexts."""
    gathered, share = np.full(1 << 16, 0.5), np.zeros(1 << 16)
    for b in range(8):
        own = np.flatnonzero((code >> (8 + b)) == 1)
        if not len(own):
            continue
        kt = _estimate(zero[own], one[own])
        log_p = np.logaddexp(kt, below[own]) - np.log(2)
        root, of = np.unique(code[own] & ((1 << b) - 1), return_inverse=True)
        z, o, deep = (np.bincount(of, x, len(root)) for x in (zero[own], one[own], log_p))
        kt0 = _estimate(z, o)
        stop = np.exp(kt0 - np.logaddexp(kt0, deep))
        g, s = stop * (o + 0.5) / (z + o + 1), 1 - stop
        stop = np.exp(kt - np.log(2) - log_p)
        gathered[code[own]] = g[of] + s[of] * stop * (one[own] + 0.5) / (zero[own] + one[own] + 1)
        share[code[own]] = s[of] * (1 - stop)
    return gathered, share


def log_prices(keys: np.ndarray, ones: np.ndarray, gathered: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Natural logarithm of the chance of each gram's last byte after the bytes before it."""
    symbol, latest = (keys & np.uint64(255)).astype(np.int64), ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    out = np.zeros(len(keys))
    for b in range(8):
        at = codes(latest, symbol >> (8 - b), b)
        one = np.clip(gathered[at] + share[at] * ones[:, b], 1e-12, 1 - 1e-12)
        out += np.log(np.where((symbol >> (7 - b)) & 1, one, 1 - one))
    return out


def _weighed(depth: int):
    """One task weighs all grams of its partition at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not parts:
            return
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        ones, needs = weigh(keys.view(np.uint64), n, depth)
        for a in range(0, len(keys), 50_000):
            k = len(keys[a : a + 50_000])
            chances = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(0, 32 * k + 1, 32, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(ones[a : a + k]))])
            empty = [pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + k]), pa.array(n[a : a + k]), chances, *empty], ["key", "n", "ones", "code", "zero", "one", "below"])
        code, zero, one, below = (np.concatenate(x) for x in zip(*needs, strict=True))
        empty = [pa.nulls(len(code), pa.int64()), pa.nulls(len(code), pa.int64()), pa.nulls(len(code), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(code.astype(np.int32)), pa.array(zero), pa.array(one), pa.array(below)], ["key", "n", "ones", "code", "zero", "one", "below"])

    return run


def _priced(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            ones = np.frombuffer(b"".join(batch.column("ones").to_pylist()), np.float32).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(log_prices(keys.view(np.uint64), ones, *shared.value).astype(np.float32))], ["key", "n", "log_p"])

    return run


# -- scores ------------------------------------------------------------------------------------


def _lists(keys: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The keys of each row as a list; rows come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(keys.view(np.int64)))


def _scored(shared, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices, price, words, times = shared.value
        for batch in batches:
            for part in ta.slices(batch, "text", ta.SLICE_BYTES // 2):
                data, offsets = ta.raw(part.column("text"))
                n = part.num_rows
                frame, places, rows = framed(data, offsets, depth)
                keys = grams(frame, places, depth)
                at = prices.find(keys)
                known = at >= 0
                score = np.bincount(rows[known], weights=price[at[known]], minlength=n).astype(float)
                rare = _lists(keys[~known], rows[~known], n)
                a, b, row = ta.words(data, offsets)
                hashes = ta.span_hash(ta.LOWER[data], a, b, 9)
                at = words.find(hashes)
                known = at >= 0
                base = np.bincount(row[known], weights=times[at[known]], minlength=n).astype(float)
                columns = [pa.array(np.bincount(row, minlength=n) + 1), pa.array(np.bincount(row[known], minlength=n)), pa.array(base), pa.array(score), pa.array(np.diff(offsets) + 1), _lists(hashes[~known], row[~known], n), rare]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), *columns], ["id", "held_out", "n_tokens", "hits", "base", "score", "coded_bytes", "words", "grams"])

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, grams: int = MOST_GRAMS, words: int = MOST_WORDS) -> DataFrame:
    """Score every text by a model of the texts outside the held-out fold.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``bits_per_byte``. The fold is crc32 of the id as text, modulo 7; remainder 2 is held out. A null id counts as an empty
    text there; a null text is empty; repeated rows are counted and scored each; a very long text is counted and scored whole, a slice of rows at a time. Columns other than the two named are not read, whatever their names; an empty table
    gives no rows.

    Model: bytes (A-Z lowered) and an end mark are coded as eight binary decisions each by context-tree weighting over the last 0 to ``depth`` bytes (2 to 7).
    Counts cover all training texts and every context that occurs in them is a node, so the tree grows with the corpus.

    Scale: one scan counts byte runs and words and sums them by key. Byte runs are dealt by their two latest bytes, so that a task
    holds whole subtrees and weighs all their depths at once, about 400,000 runs to a task; of depths 0 and 1, 65,280 nodes at most, the sums meet in the driver and the mixture goes to all tasks. The
    price of each byte run is then a column of a table. The ``grams`` most frequent prices (20 MB) and ``words`` word counts (10 MB) are broadcast; all others
    are joined by key, as (row, key) pairs, and no text is shuffled.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    docs = df.select(F.col(id_col).alias("id"), (fold == HELD_OUT).alias("held_out"), text.alias("text"))
    counts = stash(docs.select("held_out", "text").mapInArrow(_counted(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))

    runs = counts.where("kind = 0").select("key", "n")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // GRAMS_A_TASK))
    dealt = runs.repartition(tasks, F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    weighed = stash(dealt.mapInArrow(_weighed(depth), "key long, n long, ones binary, code int, zero double, one double, below double"))
    top = weighed.where("code is not null").groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "below")]).toPandas()  # 65,280 rows at most
    levels = spark.sparkContext.broadcast(top_levels(*(top[c].to_numpy() for c in ("code", "zero", "one", "below"))))
    model = stash(weighed.where("code is null").mapInArrow(_priced(levels), "key long, n long, log_p float"))

    found = counts.where("kind = 1").select("key", "n")
    prices = model.where(F.col("n") >= _threshold(model, "n", grams)).select("key", "log_p").toArrow()  # ``grams`` rows at most
    often = found.where(F.col("n") >= _threshold(found, "n", words)).toArrow()  # ``words`` rows at most
    shared = spark.sparkContext.broadcast((ta.Index(prices["key"].to_numpy().view(np.uint64)), prices["log_p"].to_numpy(), ta.Index(often["key"].to_numpy().view(np.uint64)), np.log10(often["n"].to_numpy() + 1.0)))
    del prices, often

    totals = found.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = docs.where("not held_out").count()
    tokens, kinds = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())])
    for name, kind in (("n_tokens", T.LongType()), ("hits", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("coded_bytes", T.LongType()), ("words", T.ArrayType(T.LongType())), ("grams", T.ArrayType(T.LongType()))):
        schema.add(name, kind)
    scored = stash(docs.mapInArrow(_scored(shared, depth), schema).withColumn("row", F.monotonically_increasing_id()))
    more_words = scored.select("row", F.explode("words").alias("key")).join(found, "key")
    more_words = more_words.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("more_hits"))
    more_grams = scored.select("row", F.explode("grams").alias("key")).join(model.select("key", "log_p"), "key").groupBy("row").agg(F.sum("log_p").alias("log_p"))
    end = float(np.log10(ends + 1))
    out = scored.drop("words", "grams").join(more_words, "row", "left").join(more_grams, "row", "left")
    score = (F.col("score") + F.coalesce("log_p", F.lit(0.0))) / F.lit(float(np.log(10)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"),
        score.alias("score"),
        (-score * F.lit(float(np.log2(10))) / F.col("coded_bytes")).alias("bits_per_byte"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
