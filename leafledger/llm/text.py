"""Vectorised byte-level text handling shared by the operators.

White space is ``[\\x20\\x09-\\x0D]``; these bytes never occur inside a UTF-8
sequence, so words are found on bytes.  Words get 64-bit hashes from one cumulative
polynomial over a slice of documents, without any Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, SLICE + 1)
        for i, b in enumerate((_BASE, _INVERSE)):
            full = np.full(m, b, np.uint64)
            full[0] = 1
            _powers[i] = np.cumprod(full, dtype=np.uint64)
    p, q = _powers[0][:n], _powers[1][:n]
    if len(_powers[0]) > 4 * SLICE:  # one very long text: do not keep its tables
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return p, q


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``.  Workers wait for further tasks, beside those that work: at the end of a task they release what it held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most ``most`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a slice of documents: ``start``, ``end`` (in ``data``), ``doc``, ``hash``.

    ``first`` holds for each document the index of its first word (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True):
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = data[lo:hi]
        if lower:
            raw = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
        self.data, self.offsets = raw, offsets - lo
        n = len(raw)
        solid = np.empty(n + 1, bool)
        np.logical_not(SPACE[raw], out=solid[:n])
        solid[n] = False
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:]
        ends = np.zeros(n + 1, bool)
        ends[1:] = solid[:-1] & (~solid[1:] | edge[1:])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.hash = self.spans(self.start, self.end) if hashed else None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans of this slice."""
        n = len(self.data)
        if not hasattr(self, "_sums"):
            p, self._q = _power_tables(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUE[self.data] * p[:n], out=sums[1:])
            self._sums = sums
        h = self._sums[end] - self._sums[start]
        h *= self._q[start]
        h += (end - start).astype(np.uint64)
        return mix(h)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


class Table:
    """Open-addressing map from 64-bit keys to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, 2**64 - 1, np.uint64), np.zeros(1 << bits, values.dtype)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == np.uint64(2**64 - 1)]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            rest = rest[left[rest]]
            slot[rest] = slot[rest] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.copy()) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, 0 for unknown ones."""
        slot = self._slot(keys)
        here = self.keys[slot]
        found = here == keys
        rest = np.flatnonzero(~found & (here != np.uint64(2**64 - 1)))
        while len(rest):
            slot[rest] = slot[rest] + 1 & self.mask
            here = self.keys[slot[rest]]
            hit = here == keys[rest]
            found[rest[hit]] = True
            rest = rest[~hit & (here != np.uint64(2**64 - 1))]
        return np.where(found, self.values[slot], self.values.dtype.type(0))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): each document's distinct k-word shingles, sorted.

    With fewer than k words, the whole sequence is one shingle; without words, none.
    """
    h, first, count = words.hash, words.first, words.count
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for i in range(k):
        m = max(0, n - i)
        rolled[:m] += h[i:] * _SHINGLE[i]
    mix(rolled)
    out, sizes = [], np.zeros(len(count), np.int64)
    for d in range(len(count)):
        a, c = int(first[d]), int(count[d])
        if c >= k:
            s = np.sort(rolled[a : a + c - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            s = mix(np.array([(h[a : a + c] * _SHINGLE[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64))
        else:
            continue
        sizes[d] = len(s)
        out.append(s)
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at


_SHINGLE = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
