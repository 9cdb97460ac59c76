"""Whole batches of texts as numpy arrays: words, lines and their hashes without a Python loop over rows.

A batch is one array of UTF-8 bytes and an array of offsets, as Arrow keeps it. White space means the
six characters ``[\\x20\\x09-\\x0D]``; none of their bytes occurs inside a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_POINT = (np.arange(256) & 0xC0) != 0x80  # the first byte of each code point

#: Bytes of text that one round of array work takes, unless a single text is longer.
SLICE_BYTES = 1 << 21


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``limit`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - 1) // limit
    at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true values; no run crosses from one row to the next."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = ~inside
    starts = np.flatnonzero(inside & (before[:-1] | edge[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~IS_SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each line; every row has one at least."""
    n = len(data)
    cut = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], cut + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends = np.where(last, offsets[row + 1], np.concatenate([starts[1:] - 1, [n]]) if len(starts) else starts)
    return starts, ends, row


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same spans without white space at both ends."""
    solid = np.flatnonzero(~IS_SPACE[data])
    if not len(solid):
        return starts, starts
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    return np.where(some, solid[np.minimum(a, len(solid) - 1)], starts), np.where(some, solid[np.maximum(b, 1) - 1] + 1, starts)


def points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points in each span."""
    seen = np.concatenate([[0], np.cumsum(IS_POINT[data])])
    return seen[ends] - seen[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (the splitmix finaliser)."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a plain sort."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    """Which values are in a sorted list?"""
    if not len(sorted_values):
        return np.zeros(x.shape, bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


#: Base of all running polynomials: an odd number; a seed changes the bytes' values, so that one table of powers serves all hashes.
_BASE = int(mix(np.uint64(77)).item()) | 1
_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; those for usual slices are kept."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.full(max(n, SLICE_BYTES + 1), factor, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    if n <= 2 * SLICE_BYTES + 1:
        _POWERS[:] = made
    return made


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of one running polynomial over the batch."""
    table = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Index:
    """Numbers distinct 64-bit keys in the order in which they come; an open table of twice as many places, probed for whole arrays."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys, self.size = np.zeros(1024, np.uint64), 0
        self._table = np.full(2048, -1, np.int32)
        if keys is not None:
            self.add(keys)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The highest bits of a product: keys that share their lowest bits must not crowd."""
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self._table).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that are not there."""
        mask = len(self._table) - 1
        at = self._places(keys)
        out = self._table[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            out[wrong] = found = self._table[at[wrong]]
            wrong = wrong[(found >= 0) & (self.keys[found] != keys[wrong])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Take in distinct keys that are not there yet."""
        total = self.size + len(keys)
        if total > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.size], np.zeros(max(total, 2 * len(self.keys)) - self.size, np.uint64)])
        self.keys[self.size : total] = keys
        new = np.arange(self.size, total, dtype=np.int32)
        if 2 * total > len(self._table):
            self._table = np.full(1 << int(2 * total).bit_length(), -1, np.int32)
            new = np.arange(total, dtype=np.int32)
        self.size, mask = total, len(self._table) - 1
        at = self._places(self.keys[new])
        while len(new):
            free = self._table[at] < 0
            self._table[at[free]] = new[free]
            left = self._table[at] != new
            new, at = new[left], (at[left] + 1) & mask
