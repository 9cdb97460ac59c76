"""Mixture-controlled packing: deficit round-robin over source queues, in whole windows."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text_arrays as ta
from .shared import stash

SEQUENCE = 1024
WINDOW = 32
CACHED_SEGMENTS = 1_000_000
LONG_SEGMENT = 4096
MOST_BROADCAST = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# -- tokens ------------------------------------------------------------------------------------

# How a byte-level tokenizer splits texts, and the white space its pattern knows beside ASCII.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES_OF_TWO = (0x85, 0xA0)  # after 0xC2
SPACES_OF_THREE = (0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where white-space characters of UTF-8 text begin, and where they end."""
    first = ta.IS_SPACE[data] | ((data >= 0x1C) & (data <= 0x1F))
    last = first.copy()
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], SPACES_OF_TWO)]
    three = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
    code = (data[three].astype(np.int64) << 16) | (data[three + 1].astype(np.int64) << 8) | data[three + 2]
    three = three[np.isin(code, SPACES_OF_THREE)]
    first[two] = first[three] = last[two + 1] = last[three + 2] = True
    return first, last


class Encoder:
    """Ids of a byte-level BPE for batches of texts; each distinct segment is encoded once while it is remembered.

    A space or line feed with a character on both sides that is no white space always begins a new piece of the
    tokenizer's own splitting, whatever stands around it. Texts are cut there, and a segment's ids are the same in every text. New
    segments of a batch are encoded together, one behind the other. Segments that such a cut can't describe (white space at
    an end of a text, special tokens, very long ones) are encoded one by one.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.model, self.end = Tokenizer.from_file(path), end
        self.kind = "<u2" if self.model.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
        told = json.loads(Path(path).read_text())
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items()}
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]
        self.special = [t["content"].encode() for t in told.get("added_tokens", [])]
        self.bulk = self._bulk(told["model"], vocab)
        self._forget()

    def _bulk(self, model: dict, vocab: dict[bytes, int]):
        """The same ids by ranks, where the order of the merges is the order of the ids; else by the tokenizer itself."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))):
            import tiktoken

            return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        return lambda text: self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        self.index, self.at, self.n, self.flat = ta.Index(), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _encoded(self, segments: list[bytes], joins: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments and the number of ids of each."""
        n = np.zeros(len(segments), np.int64)
        for mark in self.special:
            joins &= np.array([mark not in s for s in segments], bool)
        some = np.flatnonzero(joins)
        parts = [segments[i] if leads[i] else b"\n" + segments[i] for i in some]
        ids = np.array(self.bulk(b"".join(parts).decode()), np.int64)
        stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p) for p in parts]), "right")
        n[some] = np.diff(np.append(0, stops))
        keep = np.ones(len(ids), bool)
        bare = some[~leads[some]]
        keep[(stops - n[some])[~leads[some]]] = False  # the line feed before a segment that has none
        n[bare] -= 1
        ids = ids[keep]
        odd = {int(i): self._whole(segments[i].decode()) for i in np.flatnonzero(~joins)}
        if odd:
            pieces = dict(zip(some.tolist(), np.split(ids, np.cumsum(n[some])[:-1]), strict=True)) | {i: np.array(x, np.int64) for i, x in odd.items()}
            for i, x in odd.items():
                n[i] = len(x)
            ids = np.concatenate([pieces[i] for i in range(len(segments))])
        return ids, n

    def _learn(self, keys: np.ndarray, segments: list[bytes], joins: np.ndarray, leads: np.ndarray) -> None:
        ids, n = self._encoded(segments, joins, leads)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, ids.astype(self.kind)])
        self.at, self.n = np.concatenate([self.at, at.astype(np.int32)]), np.concatenate([self.n, n.astype(np.int32)])
        self.index.add(keys)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text followed by the end id, and where each text begins (one more place than texts)."""
        if self.index.size > CACHED_SEGMENTS or len(self.flat) > 8 * CACHED_SEGMENTS:
            self._forget()
        data, offsets = ta.raw(column)
        docs = len(offsets) - 1
        first, last = white(data)
        begins = (data == 0x20) | (data == 0x0A)
        begins[:1] = begins[-1:] = False
        begins[1:] &= ~last[:-1]
        begins[:-1] &= ~first[1:]
        edges = offsets[1:-1]
        begins[edges[edges < len(data)]] = False
        begins[edges[edges > 0] - 1] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        row = np.searchsorted(offsets, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), offsets[row + 1]) if len(starts) else starts
        keys = ta.span_hash(data, starts, ends, 12)
        place = self.index.find(keys)
        miss = np.flatnonzero(place < 0)
        if len(miss):
            fresh, one = np.unique(keys[miss], return_index=True)
            one = miss[one]
            a, b = starts[one], ends[one]
            leads = ((data[a] == 0x20) | (data[a] == 0x0A)) & (b - a > 1) & ~first[np.minimum(a + 1, len(data) - 1)]
            joins = (leads | ~first[a]) & ~last[b - 1] & (b - a < LONG_SEGMENT)
            self._learn(fresh, [data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], joins, leads)
            place[miss] = self.index.find(keys[miss])
        n, at = self.n[place].astype(np.int64), self.at[place].astype(np.int64)
        stop = np.cumsum(n)
        step = np.arange(stop[-1] if len(stop) else 0)
        out = np.full(len(step) + docs, self.end, self.kind)
        out[np.repeat(row, n) + step] = self.flat[np.repeat(at - stop + n, n) + step]
        return out, np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=docs).astype(np.int64) + 1)])


def _tokenize(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, end)
        before: dict[str | None, int] = {}
        for batch in batches:
            for part in ta.slices(batch, "text", 2 * ta.SLICE_BYTES):
                ids, edges = encode(part.column("text"))
                sizes = np.diff(edges)
                sources = part.column("source").dictionary_encode(null_encoding="encode")
                code = sources.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                ahead = np.cumsum(sizes[order]) - sizes[order]
                starts = np.zeros(len(sizes), np.int64)
                cut = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
                for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                    name, own = sources.dictionary[int(code[order[a]])].as_py(), order[a:b]
                    starts[own] = before.get(name, 0) + ahead[a:b] - ahead[a]
                    before[name] = int(starts[own[-1]] + sizes[own[-1]])
                kept = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("part"), pa.array(starts), pa.array(sizes), kept], ["doc_id", "source", "part", "before", "n", "ids"])

    return run


# -- schedule ----------------------------------------------------------------------------------


class Schedule:
    """Deficit round-robin over queues of tokens.

    In each window every queue that still has tokens earns its quantum, its target share of the window, and gives as many whole
    tokens as its credit allows; the deficit, less than a token, is carried to the next window. A queue that runs empty earns no
    more, and what it no longer takes is shared by the others in proportion to their targets. The credit earned after ``w`` windows has a closed
    form (all queues earn ``weight`` times one common clock until they are empty), so that a task can enter the round at any window with
    the deficits that the windows before it have left, and all tasks agree.
    """

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, window: int):
        self.tokens, self.window, self.total = np.asarray(tokens, np.int64), window, int(np.sum(tokens))
        self.weights = np.asarray(weights, np.float64)
        self.empty = self.tokens / self.weights  # the clock when each queue runs empty
        order = np.argsort(self.empty, kind="stable")
        self.clock = np.concatenate([[0.0], self.empty[order]])
        self.done = np.concatenate([[0.0], np.cumsum(self.tokens[order].astype(np.float64))])  # tokens of the queues that are empty by then
        self.rate = np.append(np.cumsum(self.weights[order][::-1])[::-1], 0.0)  # weights of those that are not
        self.knots = self.done + self.clock * self.rate
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def _clock(self, w: int) -> float:
        """The clock when ``w`` windows' tokens have been earned."""
        x = float(w) * self.window
        k = int(np.searchsorted(self.knots, x, "right")) - 1
        if k >= len(self.tokens):
            return np.inf
        return min(self.clock[k + 1], max(self.clock[k], (x - self.done[k]) / self.rate[k]))

    def credit(self, w: int) -> np.ndarray:
        """Tokens earned by each queue in its first ``w`` windows, with fractions."""
        return self.weights * np.minimum(self._clock(w), self.empty) if w * self.window < self.total else self.tokens.astype(np.float64)

    def given(self, w: int) -> np.ndarray:
        """Whole tokens given by each queue in its first ``w`` windows; the rest of the credit is its deficit."""
        if w * self.window >= self.total:
            return self.tokens
        clock = self._clock(w)
        return np.where(self.empty <= clock, self.tokens, np.minimum(np.floor(self.weights * clock).astype(np.int64), self.tokens))

    def _round(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Given before and after window ``w``, and where each queue's tokens of this window stand in the stream."""
        if w not in self.kept:
            if len(self.kept) > max(16, 1_000_000 // max(1, len(self.tokens))):
                self.kept.clear()
            now, then = self.given(w), self.given(w + 1)
            self.kept[w] = now, then, int(now.sum()) + np.cumsum(then - now) - (then - now)
        return self.kept[w]

    def spans(self, queue: int, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """Tokens [a, b) of a queue as (first token, tokens, place in the packed stream)."""
        clock = a / self.weights[queue]
        k = min(int(np.searchsorted(self.clock, clock, "right")) - 1, len(self.tokens))
        w = max(0, int(self.done[k] + clock * self.rate[k]) // self.window)
        while w > 0 and self._round(w)[0][queue] > a:
            w -= 1
        while a < b:
            while self._round(w)[1][queue] <= a:
                w += 1
            now, then, place = self._round(w)
            n = min(b, int(then[queue])) - a
            yield a, n, int(place[queue]) + a - int(now[queue])
            a += n
            w += 1


def _cut(schedule, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(*schedule.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, queue, base, before, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "base", "before", "n", "ids")), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                first = base + before
                for a, length, place in plan.spans(queue, first, first + n):
                    while length:
                        take = min(length, sequence - place % sequence)
                        x = a - first
                        out.append((doc_id, x, take, zlib.crc32(ids[4 * x : 4 * (x + take)]), n, place // sequence, place % sequence))
                        a, length, place = a + take, length - take, place + take
            columns = list(zip(*out, strict=True)) or [()] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shares: Mapping[str | None, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, end: int = 0) -> DataFrame:
    """Pack whole documents into sequences of ``sequence`` tokens; one row per piece.

    Each source is a queue. A window is the tokens of ``window`` sequences, or of as many sequences as there are sources if that is
    more. In every window a queue gives its target share of the tokens, and deficits of less than a token are carried to
    the next window (`Schedule`). ``shares`` are target proportions by source, above 0; a source that it does not name gets its
    share of all tokens. Without ``shares`` all targets are the sources' shares of all tokens, so that every window has the token proportions of the
    whole table and all queues end together. With others, windows meet the targets until a source runs out. Nothing is dropped
    or repeated; windows follow each other without gaps, so only the last sequence can need padding.

    A document is its ids and ``end``. A null or empty text is ``end`` alone; a null id stays null; a null
    source is a queue of its own; repeated rows are packed each; a very long text is cut over many windows. Columns other than the three named are
    not read, whatever their names. An empty table gives no rows.

    Scale: ids are computed once, written to the shared folder, and cut in place: what moves between tasks is
    only a count by (partition, source), which gives each partition the place where it enters each queue. Every task gets the queues' sizes and
    weights: 16 bytes a source.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), F.spark_partition_id().alias("part"))
    ids = stash(docs.mapInArrow(_tokenize(tokenizer, end), "doc_id long, source string, part int, before long, n long, ids binary"))

    parts = ids.groupBy("source", "part").agg(F.sum("n").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stash(parts.select("source", "part", "m", F.coalesce(earlier, F.lit(0)).alias("base")))
    queues = sorted(((r["source"], r["m"]) for r in parts.groupBy("source").agg(F.sum("m").alias("m")).collect()), key=lambda q: (q[0] is None, (q[0] or "").encode()))
    tokens = np.array([m for _, m in queues], np.int64)
    weights = np.array([(shares or {}).get(s, m / max(1, int(tokens.sum()))) for s, m in queues], np.float64)
    if not (weights > 0).all():
        raise ValueError("a source's share must be above 0")
    schedule = spark.sparkContext.broadcast((tokens, weights, sequence * max(window, len(queues))))

    numbers = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(queues)], "s string, queue int")
    bases = parts.join(numbers, F.col("source").eqNullSafe(F.col("s"))).select("source", "queue", F.col("part").alias("p"), "base")
    if parts.count() <= MOST_BROADCAST:  # else an ordinary join deals out the ids
        bases = F.broadcast(bases)
    placed = ids.join(bases.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "queue", "base", "before", "n", "ids").mapInArrow(_cut(schedule, sequence), PIECES)


def op10_mixture_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
