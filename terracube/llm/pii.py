"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text_arrays as ta
from .shared import kept_model

#: Of the labelled table, the features and the training: models that were kept by another version are not used.
VERSION = 1
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
WORDS_A_SEQUENCE = 256

# -- fixed patterns ----------------------------------------------------------------------------

# The same matches as the plain patterns, but each starts only where one can start, so that
# a long run of letters or digits is read once.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield a, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


FINDERS = (_emails, _ips, _cards, _phones)


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, by start, then kind."""
    return sorted(((a, b, k) for k, find in enumerate(FINDERS) for a, b in find(text)), key=lambda s: (s[0], s[2]))


# -- word shapes -------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.int8)  # 0: other
_CLASS[128:] = 1
for _set, _class in (("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 1), ("0123456789", 2), ("@", 3), (".", 4), ("-", 5), ("()", 6), ("+", 7), (":/_=", 8)):
    _CLASS[[ord(c) for c in _set]] = _class
_EDGE = np.isin(_CLASS, (1, 2, 6, 7))
_TELLING = np.isin(_CLASS, (2, 3, 7))
_DIGIT_STEP = np.array([0, 1, 2, 3, 4, 5, 5, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 7, 7])
#: Sizes of the features of one word: digits, letters with digits, dots, at signs, first with last, dashes with brackets, separators with length.
SIZES = (9, 12, 12, 6, 64, 9, 8)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
PLAIN = 0  # the shape number of a word without digits, at sign or plus


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature numbers of each word: one column for each of SIZES."""
    kind = _CLASS[data]
    edge = np.flatnonzero(_EDGE[data])
    a, b = np.searchsorted(edge, starts), np.searchsorted(edge, ends)
    some = b > a
    if len(edge):
        first, last = kind[edge[np.minimum(a, len(edge) - 1)]], kind[edge[np.maximum(b, 1) - 1]]
    else:
        first = last = np.zeros(len(starts), np.int8)
    first, last = np.where(some, first, 0), np.where(some, last, 0)
    n = {c: (s := np.concatenate([[0], np.cumsum(kind == c)]))[ends] - s[starts] for c in range(1, 9)}
    length = ends - starts
    digits = np.where(n[2] < 20, _DIGIT_STEP[np.minimum(n[2], 19)], 8)
    letters = np.digitize(n[1], (1, 4, 12))
    columns = [
        digits,
        letters * 3 + np.minimum(n[2], 2),
        np.minimum(n[4], 3) * 3 + (n[2] > 0) + (n[1] > 0),
        np.minimum(n[3], 2) * 2 + (n[4] > 0),
        first * 8 + np.minimum(last, 7),
        np.minimum(n[5], 2) * 3 + np.minimum(n[6], 2),
        np.minimum(n[8], 1) * 4 + np.digitize(length, (4, 9, 16)),
    ]
    return np.stack(columns, axis=1) + OFFSETS[:-1]


def features(shape: np.ndarray, telling: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Own features of each word and the digits and letters of both neighbours; plain words have no shape of their own."""
    own = shape.copy()
    own[~telling] = OFFSETS[:-1]
    width = int(OFFSETS[-1])
    neighbours = own[:, [0, 1, 4]]
    before = np.roll(neighbours, 1, axis=0) + width
    after = np.roll(neighbours, -1, axis=0) + 2 * width
    before[first] = 3 * width
    after[last] = 3 * width + 1
    return np.concatenate([own + 0, before, after], axis=1)


N_FEATURES = 3 * int(OFFSETS[-1]) + 2

# -- the random field --------------------------------------------------------------------------


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.emit, self.step, self.start = emit, step, start

    def arrays(self) -> list[np.ndarray]:
        return [self.emit, self.step, self.start]

    def plain_is_settled(self) -> bool:
        """Is a word without digits, at sign or plus between two such words outside every best path but the plain one?"""
        own = np.concatenate([OFFSETS[:-1], OFFSETS[:-1][[0, 1, 4]] + OFFSETS[-1], OFFSETS[:-1][[0, 1, 4]] + 2 * OFFSETS[-1]])
        ways = [own, np.r_[own[:7], [3 * OFFSETS[-1]] * 3, own[10:]], np.r_[own[:10], [3 * OFFSETS[-1] + 1] * 3], np.r_[own[:7], [3 * OFFSETS[-1]] * 3, [3 * OFFSETS[-1] + 1] * 3]]
        most = max(self.step.max(), self.start.max())
        return all((e := self.emit[w].sum(axis=0))[1:].max() + most < e[0] + min(self.step[0, 0], self.start[0]) for w in ways)

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi for many sequences at once; ``scores`` holds their words one after another."""
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        back = np.zeros(scores.shape, np.int8)
        now = self.start + scores[starts]
        final = now.copy()
        live = len(starts)
        for t in range(1, int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))
            ways = now[:live, :, None] + self.step[None]
            back[starts[:live] + t] = ways.argmax(axis=1)
            now = ways.max(axis=1) + scores[starts[:live] + t]
            final[:live] = now
        out = np.zeros(len(scores), np.int8)
        label = final.argmax(axis=1)
        for t in range(int(lengths[0]) - 1 if len(lengths) else -1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            at = starts[:live] + t
            ends = lengths[:live] == t + 1
            label[:live] = np.where(ends, final[:live].argmax(axis=1), label[:live])
            out[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return out


def fit(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a small penalty: forward and backward sums over padded sequences, Adam steps."""
    n, k, most = len(lengths), len(LABELS), int(lengths.max())
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    grid = at[:, None] + np.minimum(np.arange(most), lengths[:, None] - 1)
    real = np.arange(most) < lengths[:, None]
    w = [np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    gold = np.eye(k)[y]
    for r in range(1, rounds + 1):
        emit = w[0][x].sum(axis=1)
        e = emit[grid]
        f = np.zeros((n, most, k))
        b = np.zeros((n, most, k))
        f[:, 0] = w[2] + e[:, 0]
        for t in range(1, most):
            z = f[:, t - 1, :, None] + w[1]
            top = z.max(axis=1, keepdims=True)
            f[:, t] = np.where(real[:, t, None], np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] + e[:, t], f[:, t - 1])
        for t in range(most - 2, -1, -1):
            z = w[1] + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            top = z.max(axis=2, keepdims=True)
            b[:, t] = np.where(real[:, t + 1, None], np.log(np.exp(z - top).sum(axis=2)) + top[..., 0], 0)
        total = np.log(np.exp(f[:, -1] - f[:, -1].max(axis=1, keepdims=True)).sum(axis=1)) + f[:, -1].max(axis=1)
        p = np.exp(f + b - total[:, None, None])
        words = np.zeros_like(gold)
        words[grid[real]] = p[real]
        g0 = np.zeros_like(w[0])
        np.add.at(g0, x, (gold - words)[:, None, :])
        g1 = np.zeros_like(w[1])
        for t in range(1, most):
            z = f[:, t - 1, :, None] + w[1] + (e[:, t] + b[:, t])[:, None, :] - total[:, None, None]
            g1 -= np.exp(z)[real[:, t]].sum(axis=0)
        inside = np.ones(len(y), bool)
        inside[at] = False
        np.add.at(g1, (y[np.flatnonzero(inside) - 1], y[inside]), 1)
        g2 = gold[at].sum(axis=0) - p[:, 0].sum(axis=0)
        for i, g in enumerate((g0, g1, g2)):
            g = g / n - decay * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
    return Field(*w)


# -- the labelled table ------------------------------------------------------------------------


def labelled_table(rows: int = 900, seed: int = 11) -> list[list[tuple[str, int]]]:
    """A small labelled table: sentences as (word, label), made by rule from a seed.

    Personal data in the forms that people write, among words, numbers, dates, versions, hexadecimal keys and decimals.
    """
    rng = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    word = lambda: letters(int(rng.integers(1, 11)))

    def card() -> str:
        head = digits(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def thing() -> tuple[list[str], int]:
        c = card()
        four = [c[i : i + 4] for i in range(0, 16, 4)]
        area, mid, end = digits(3), digits(3), digits(4)
        host = f"{word()}.{letters(2)}{letters(1)}"
        return [
            ([f"{word()}.{digits(2)}@{host}"], 1), ([f"{word()}@{host}"], 1), ([f"{word()}_{word()}@{word()}.{host}"], 1),
            ([".".join(str(x) for x in rng.integers(0, 256, 4))], 2), ([".".join(str(x) for x in rng.integers(1, 256, 4)) + ":" + digits(4)], 2),
            ([c], 3), (["-".join(four)], 3), (four, 3), ([".".join(four)], 3),
            ([f"+{digits(1)}", f"({area})", f"{mid}-{end}"], 4), ([f"({area})", f"{mid}-{end}"], 4), ([f"{area}-{mid}-{end}"], 4),
            ([f"+{digits(2)}", area, mid, end], 4), ([f"+{digits(11)}"], 4), ([f"{area}.{mid}.{end}"], 4),
        ][int(rng.integers(0, 15))]

    def noise() -> list[str]:
        return [
            [digits(int(rng.integers(1, 9)))], [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [f"{digits(2)}.{digits(2)}"],
            ["token", "=", '"' + hashlib.md5(digits(9).encode()).hexdigest() + '"'], [f"v{digits(1)}.{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [f"{word()}{digits(2)}"],
            [f"({digits(2)})"], [f"{digits(3)},{digits(3)}"], [hashlib.md5(digits(9).encode()).hexdigest()[:20]], ["@" + word()], [f"{digits(2)}%"], [f"{digits(3)}-{digits(2)}"], [f"+{digits(1)}"],
        ][int(rng.integers(0, 15))]

    table = []
    for _ in range(rows):
        line: list[tuple[str, int]] = []
        for _ in range(int(rng.integers(1, 4))):
            line += [(word(), 0) for _ in range(int(rng.integers(1, 6)))]
            pick = rng.random()
            if pick < 0.4:
                words, label = thing()
                line += [(w, label) for w in words]
            elif pick < 0.75:
                line += [(w, 0) for w in noise()]
        line += [(word(), 0) for _ in range(int(rng.integers(1, 4)))]
        mark = ["", ".", ",", "###", "&&&"][int(rng.choice(5, p=[0.6, 0.15, 0.15, 0.05, 0.05]))]
        table.append([(w + mark if rng.random() < 0.3 else w, label) for w, label in line])
    return table


def _arrays(table: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in table])
    words = [w.encode() for line in table for w, _ in line]
    data = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes + 1) - sizes - 1
    first = np.cumsum(lengths) - lengths
    x = features(shapes(data, starts, starts + sizes), _any(data, starts, starts + sizes), first, first + lengths - 1)
    return x, np.array([label for line in table for _, label in line]), lengths


def _any(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_TELLING[data])])
    return seen[ends] > seen[starts]


@lru_cache(maxsize=4)
def trained(rows: int = 900, seed: int = 11) -> Field:
    return fit(*_arrays(labelled_table(rows, seed)))


# -- documents ---------------------------------------------------------------------------------


def _sequences(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """First word of each sequence: a line, and within it a cut at the first plain word after every 256 words."""
    n = len(starts)
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    line = breaks[starts]
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    plain = np.flatnonzero(~telling)
    for a in first[np.diff(np.append(first, n)) > WORDS_A_SEQUENCE]:
        b = first[i] if (i := np.searchsorted(first, a) + 1) < len(first) else n
        cut = np.searchsorted(plain, np.arange(a + WORDS_A_SEQUENCE, b, WORDS_A_SEQUENCE))
        cut = plain[cut[cut < len(plain)]]
        new[cut[cut < b]] = True
    return np.flatnonzero(new)


_FOUR_PARTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")


def _sound(kind: int, text: str) -> bool:
    """An added span must hold what its kind needs."""
    digits = "".join(_DIGITS.findall(text))
    if kind == 0:
        return 0 < text.find("@") < len(text) - 3
    if kind == 1:
        return bool(m := _FOUR_PARTS.search(text)) and all(int(x) <= 255 for x in m[0].split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def found_by_field(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start byte, end byte, kind) of runs of words with one label."""
    starts, ends, row = ta.words(data, offsets)
    if not len(starts):
        return []
    telling = _any(data, starts, ends)
    first = _sequences(data, offsets, starts, ends, row, telling)
    size = np.diff(np.append(first, len(starts)))
    if field.plain_is_settled():
        seen = np.concatenate([[0], np.cumsum(telling)])
        keep = seen[first + size] > seen[first]
        first, size = first[keep], size[keep]
    if not len(first):
        return []
    word = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    at = np.cumsum(size) - size
    x = features(shapes(data, starts[word], ends[word]), telling[word], at, at + size - 1)
    label = field.best(field.emit[x].sum(axis=1), size)
    begin = np.zeros(len(word), bool)
    begin[at] = True
    begin[1:] |= label[1:] != label[:-1]
    run = np.flatnonzero(begin)
    stop = np.append(run[1:], len(word)) - 1
    named = label[run] > 0
    return [(int(row[word[a]]), int(starts[word[a]]), int(ends[word[b]]), int(label[a]) - 1) for a, b in zip(run[named], stop[named], strict=True)]


_TRIM_LEFT, _TRIM_RIGHT = re.compile(r"^[^\w(+]+"), re.compile(r"[^\w)]+$")


def spans_of_batch(field: Field, texts: list[str], column: pa.Array) -> list[tuple[list, list]]:
    """For each text its pattern spans and all spans, as (start, end, kind) in code points."""
    data, offsets = ta.raw(column)
    seen = np.concatenate([[0], np.cumsum(_TELLING[data])])
    some = seen[offsets[1:]] > seen[offsets[:-1]]
    base = [fixed_spans(t) if s else [] for t, s in zip(texts, some, strict=True)]
    full = [list(b) for b in base]
    for i, a, b, kind in found_by_field(field, data, offsets):
        head = int(ta.IS_POINT[data[offsets[i] : a]].sum())
        own = data[a:b].tobytes().decode()
        left = len(m[0]) if (m := _TRIM_LEFT.search(own)) else 0
        core = _TRIM_RIGHT.sub("", own[left:])
        lo, hi = head + left, head + left + len(core)
        if core and _sound(kind, core) and not any(x < hi and lo < y for x, y, _ in base[i]):
            full[i].append((lo, hi, kind))
    return [(b, sorted(f, key=lambda s: (s[0], s[2]))) for b, f in zip(base, full, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(df: DataFrame, text_col: str = "text", rows: int = 900, seed: int = 11) -> DataFrame:
    """Find the personal data of each row: all columns, and ``pii_base`` and ``pii_spans`` (arrays of kind, start, end).

    Offsets count code points, ends are exclusive. ``pii_base`` has what the fixed patterns match,
    ``pii_spans`` also what the random field finds where no pattern matched and what passes its kind's check of digits.
    Null and empty texts have no spans; repeated rows are read each; lines of a very long text are sequences of their own, long ones cut between plain
    words; columns of the same names are replaced, all others stay. One pass over the texts, no shuffle.
    """
    df = df.drop("pii_base", "pii_spans")
    arrays = kept_model(df.sparkSession, f"pii-{VERSION}-{rows}-{seed}", lambda: trained(rows, seed).arrays())
    model = df.sparkSession.sparkContext.broadcast(Field(*arrays))  # some thousand numbers
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*df.schema.fields, T.StructField("pii_base", span), T.StructField("pii_spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch, text_col):
                column = part.column(text_col)
                found = spans_of_batch(model.value, [t or "" for t in column.to_pylist()], column)
                new = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in x[j]] for x in found], kind) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "pii_base", "pii_spans"])

    return df.mapInArrow(run, schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("pii_base"), 256).alias("base_sha256"), text("pii_spans").alias("spans"))
