"""Quality classifier: overlapping heuristic labellers, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta

LABELLERS = ("symbol_share", "marked_words", "shouted_letters", "shouted_words", "exclamations", "bar_words", "repeated_lines", "repeated_words", "odd_length", "stutter", "told_stem", "told_stems", "few_marks", "plain_prose", "closed_lines")

CELLS = 1 << 18
SAMPLE = 3_000
SAMPLE_BYTES = 1 << 25
LABELLED_SAMPLE = 16_000
RESULTS = ("quality_score", "label_score", "votes", "keep")

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*^~|<>{}[]\\=_"])
_UPPER, _ASCII_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER | (np.arange(256) >= 128)


class Parsed(NamedTuple):
    """One slice of texts, taken apart once for labellers and features."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    word: np.ndarray  # hash of the word in lower case, without punctuation around it
    stems: tuple[np.ndarray, np.ndarray]  # hashes of its first four and five bytes
    tail: np.ndarray  # hash of what follows the word's last letter or digit
    upper: np.ndarray  # capital and other letters of each word
    letters: np.ndarray


def parse(column: pa.Array) -> Parsed:
    data, offsets = ta.raw(column)
    a, b, row = ta.words(data, offsets)
    solid = np.flatnonzero(_LETTER[data] | ((data >= 48) & (data < 58)))
    i, j = np.searchsorted(solid, a), np.searchsorted(solid, b)
    some = j > i
    if len(solid):
        first, last = np.where(some, solid[np.minimum(i, len(solid) - 1)], a), np.where(some, solid[np.maximum(j, 1) - 1] + 1, a)
    else:
        first = last = a
    low = ta.LOWER[data]
    up, let = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_LETTER[data])])
    return Parsed(data, offsets, a, b, row, ta.span_hash(low, first, last, 3), tuple(ta.span_hash(low, first, np.minimum(first + k, last), 10 + k) for k in (4, 5)), ta.span_hash(low, last, b, 4), up[b] - up[a], let[b] - let[a])


def _kinds(row: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Distinct items of each row."""
    if not len(row):
        return np.zeros(n, np.int64)
    both = ta.distinct((row.astype(np.uint64) << np.uint64(44)) | (ta.mix(item ^ row.astype(np.uint64)) >> np.uint64(20)))
    return np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=n)


def items(p: Parsed) -> np.ndarray:
    """What the told lexicon may hold of each word: the word and its stems."""
    return np.stack([p.word, *p.stems])


def votes(p: Parsed, lexicon: np.ndarray) -> np.ndarray:
    """One row for each text, one column for each labeller: 1 good, -1 bad, 0 no opinion."""
    n = len(p.offsets) - 1
    count = lambda mask: np.bincount(p.row[mask], minlength=n)
    share = lambda x, of: x / np.maximum(of, 1)
    inside = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[p.offsets])
    words = np.bincount(p.row, minlength=n)
    size = p.end - p.start
    solid, letters, capitals = inside(~ta.IS_SPACE[p.data]), inside(_LETTER[p.data]), inside(_UPPER[p.data])
    symbols = share(inside(_SYMBOL[p.data]), solid)
    bare = p.letters == 0
    last_symbol = _SYMBOL[p.data[p.end - 1]] if len(p.end) else np.zeros(0, bool)
    marked = share(count(last_symbol & ~bare), words)
    shouted = share(count((p.upper == p.letters) & (p.letters > 1)), words)
    bars = share(count((size == 1) & bare & last_symbol), words)
    bang = (size > 1) & (p.data[p.end - 1] == 33) & (p.data[np.maximum(p.end - 2, 0)] == 33) if len(p.end) else np.zeros(0, bool)
    bangs = share(count(bang), words)

    a, b, row = ta.lines(p.data, p.offsets)
    a, b = ta.stripped(p.data, a, b)
    full = b > a
    rows, line = row[full], ta.span_hash(p.data, a, b, 6)[full]
    total = np.bincount(rows, minlength=n)
    distinct = _kinds(rows, line, n)
    again = share(total - distinct, total)
    ended = np.isin(p.data[b[full] - 1], [ord(c) for c in '.!?:;"'])
    closed = share(np.bincount(rows[ended], minlength=n), total)
    variety = share(_kinds(p.row, p.word, n), words)
    same = np.zeros(len(p.row), bool)
    same[1:] = (p.row[1:] == p.row[:-1]) & (p.word[1:] == p.word[:-1]) & (p.letters[1:] > 0)
    stutter = share(count(same), words)
    told = ta.among(items(p), lexicon).any(axis=0)
    told = _kinds(p.row[told], p.word[told], n)
    mean = share(np.bincount(p.row, weights=size, minlength=n), words)

    bad = lambda x: np.where(x, -1, 0)
    unmarked = (symbols < 0.02) & (shouted < 0.15) & (bangs < 0.03) & (bars < 0.03) & (told < 2) & (stutter < 0.2)
    plain = unmarked & (words >= 5) & (symbols < 0.01) & (again < 0.2) & (mean < 14) & (stutter < 0.1) & (told < 1)
    return np.stack(
        [
            bad(symbols > 0.08), bad(marked > 0.2), bad((share(capitals, letters) > 0.35) & (letters > 20)), bad((shouted > 0.3) & (words > 3)), bad((bangs > 0.15) & (words > 3)),
            bad((bars > 0.15) & (words > 5)), bad((again > 0.4) & (total > 3)), bad((variety < 0.08) & (words > 200)), bad((mean > 25) & (words > 3)),
            bad((stutter > 0.25) & (words > 5)), bad(told >= 1), bad(told >= 2), np.where(unmarked & (words > 0), 1, 0), np.where(plain, 1, 0), np.where(plain & (closed > 0.9), 1, 0),
        ],
        axis=1,
    ).astype(np.int8)


def features(p: Parsed, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and value of the hashed features: which words and stems occur, the share of each ending and letter case, the votes."""
    n = len(p.offsets) - 1
    words = np.maximum(np.bincount(p.row, minlength=n), 1)
    half = np.uint64(CELLS // 2)
    keys = ta.distinct(np.concatenate([(p.row.astype(np.uint64) << np.uint64(20)) | (x % half) for x in items(p)]))
    r1, c1 = (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
    case = np.where(p.letters == 0, 0, np.where(p.upper == 0, 1, np.where(p.upper < p.letters, 2, np.where(p.letters > 1, 3, 4)))).astype(np.uint64)
    shape = np.concatenate([(p.row.astype(np.uint64) << np.uint64(20)) | (p.tail % half), (p.row.astype(np.uint64) << np.uint64(20)) | (half - np.uint64(8) + case)])
    keys, times = np.unique(shape, return_counts=True)
    r2, c2 = (keys >> np.uint64(20)).astype(np.int64), (keys & np.uint64((1 << 20) - 1)).astype(np.int64) + CELLS // 2
    r3, j = np.nonzero(v)
    c3 = CELLS // 2 - 100 + 2 * j + (v[r3, j] > 0)
    few = 5 / np.sqrt(np.bincount(r1, minlength=n) + 25)  # so that many indifferent words don't outvote a telling one
    return np.concatenate([r1, r2, r3]), np.concatenate([c1, c2, c3]), np.concatenate([few[r1], 10 * times / words[r2], np.full(len(r3), 3.0)])


# -- label model -------------------------------------------------------------------------------


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, start: float = 0.85, weight: float = 0.02) -> np.ndarray:
    """Accuracy of each labeller by expectation-maximisation over the counts of vote patterns.

    A labeller that speaks is right with its accuracy, whatever the class; both classes are as likely beforehand.
    A pull of ``weight`` of all rows towards ``start`` keeps a labeller that never overlaps from drifting.
    """
    accuracy = np.full(patterns.shape[1], start)
    spoken = (patterns != 0) * counts[:, None]
    pull = weight * counts.sum() + 1
    for _ in range(rounds):
        good = posterior(patterns, accuracy)[:, None]
        right = (np.where(patterns > 0, good, 1 - good) * spoken).sum(axis=0)
        accuracy = np.clip((right + pull * start) / (spoken.sum(axis=0) + pull), 0.55, 0.995)
    return accuracy


def posterior(patterns: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """Chance that a row with these votes is good."""
    return 1 / (1 + np.exp(-np.clip(patterns @ np.log(accuracy / (1 - accuracy)), -30, 30)))


def linear(row: np.ndarray, cell: np.ndarray, value: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features and soft labels: whole-batch AdaGrad steps."""
    w, bias, seen, n = np.zeros(CELLS, np.float32), 0.0, np.full(CELLS, 1e-8, np.float32), max(len(label), 1)
    if not len(label):
        return w, bias
    balance = np.where(label > 0.5, 0.5 / max(np.mean(label > 0.5), 0.05), 0.5 / max(np.mean(label <= 0.5), 0.05))
    seen_bias = 1e-8
    for _ in range(rounds):
        z = np.bincount(row, weights=w[cell] * value, minlength=len(label)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * balance / n
        g = np.bincount(cell, weights=d[row] * value, minlength=CELLS).astype(np.float32) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen) * (g != 0)
        seen_bias += d.sum() ** 2
        bias -= rate * d.sum() / np.sqrt(seen_bias)
    return w, bias


# -- tables ------------------------------------------------------------------------------------


def _sampled(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                p = parse(part.column("text"))
                v = votes(p, lexicon.value)
                row, cell, value = features(p, v)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[order])) for x in (cell.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, x)) for x in v.tolist()]), *lists], ["votes", "cells", "values"])

    return run


def _patterns(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, "text"):
                found, times = np.unique(votes(parse(part.column("text")), lexicon.value), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, v)) for v in found.tolist()]), pa.array(times.astype(np.int64))], ["votes", "n"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.slices(batch, "text"):
            p = parse(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)
            row, item = np.tile(p.row, 3), items(p).ravel()
            order = np.lexsort((item, row))
            row, item = row[order], item[order]
            new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)]
            yield pa.RecordBatch.from_arrays([pa.array(item[new].view(np.int64)), pa.array(toxic[row[new]].astype(np.int32))], ["item", "toxic"])


def told_lexicon(df: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, sample: int, share: float = 0.01, rare: float = 0.005) -> np.ndarray:
    """Words and stems that a sample of labelled rows (``2 * sample`` rows at most) has in toxic texts and nearly nowhere else."""
    if labels is None:
        return np.zeros(0, np.uint64)
    labels = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "toxic")
    step = max(1, labels.count() // sample)
    some = labels.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).orderBy(F.xxhash64(id_col), id_col, "toxic").limit(2 * sample)
    texts = df.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), id_col).select("text", "toxic").dropDuplicates(["text", "toxic"])
    counts = texts.mapInArrow(_items, "item long, toxic int").groupBy("item").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    least = max(3, int(share * (some.where("toxic = 1").count())))
    kept = counts.where((F.col("a") >= least) & (F.col("b") <= rare * F.col("a"))).select("item").toPandas()
    return np.sort(kept["item"].to_numpy(np.int64).view(np.uint64))


class Model(NamedTuple):
    lexicon: np.ndarray
    accuracy: np.ndarray
    cells: np.ndarray  # weights by hash cell
    bias: float


def fit(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from the texts. Vote patterns are counted over all rows; the linear scorer learns from about ``sample`` rows
    chosen by hash, never from more than twice as many, nor from more than ``SAMPLE_BYTES`` of text (and what the last row has beyond that); rows that repeat
    an id with its text count once there. ``labels`` (id, toxic), if given, tells one labeller which words to mind."""
    context = df.sparkSession.sparkContext
    lexicon = told_lexicon(df, labels, id_col, text_col, LABELLED_SAMPLE)
    shared = context.broadcast(lexicon)
    texts = df.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    found = texts.select("text").mapInArrow(_patterns(shared), "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return Model(lexicon, np.full(len(LABELLERS), 0.85), np.zeros(CELLS, np.float32), 0.0)
    patterns = np.array([[int(x) for x in v.split(",")] for v in found["votes"]])
    accuracy = label_model(patterns, found["n"].to_numpy())
    step = max(1, int(found["n"].sum()) // sample)
    chosen = texts.where(F.pmod("h", F.lit(step)) == 0)
    sizes = chosen.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).distinct().orderBy("h").limit(2 * sample).toPandas()  # two numbers a row
    last = sizes["h"][sizes["n"].cumsum() - sizes["n"] < SAMPLE_BYTES].max()
    rows = chosen.where(F.col("h") <= int(last) if len(sizes) else F.lit(False)).dropDuplicates(["h"]).orderBy("h").select("text")
    got = rows.mapInArrow(_sampled(shared), "votes string, cells array<int>, values array<float>").toArrow()
    good = posterior(np.array([[int(x) for x in v.split(",")] for v in got["votes"].to_pylist()]).reshape(got.num_rows, -1), accuracy)
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(got["cells"]).to_numpy())
    weights, bias = linear(row, pc.list_flatten(got["cells"]).to_numpy(), pc.list_flatten(got["values"]).to_numpy(), good)
    return Model(lexicon, accuracy, weights.astype(np.float32), float(bias))


def score_quality(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """All columns and ``quality_score`` (chance that the row is good by the linear scorer), ``label_score`` (by the
    labellers alone), ``votes`` (one number a labeller), ``keep`` (score of ``least`` or more).

    Null and empty texts, which no labeller speaks about, get a half and are kept. Repeated rows count each. Columns of the
    same names are replaced, all others stay; a very long text is read whole. A few scans of the texts and no shuffle of them; 1 MB of weights goes to each task.
    """
    df = df.drop(*RESULTS)
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, id_col, text_col, sample))
    kinds = [T.DoubleType(), T.DoubleType(), T.ArrayType(T.IntegerType()), T.BooleanType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, k) for c, k in zip(RESULTS, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in ta.slices(batch, text_col):
                p = parse(part.column(text_col))
                v = votes(p, m.lexicon)
                row, cell, value = features(p, v)
                z = np.bincount(row, weights=m.cells[cell] * value, minlength=part.num_rows).astype(float) + m.bias
                score = np.where(np.bincount(p.row, minlength=part.num_rows) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.5)
                new = [pa.array(score), pa.array(posterior(v, m.accuracy)), pa.array(list(v.astype(np.int32)), pa.list_(pa.int32())), pa.array(score >= least)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *RESULTS])

    return df.mapInArrow(run, schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "keep", "quality_score", "label_score", "votes")
