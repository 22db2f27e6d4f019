"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library.

White space always separates pre-tokens of the supported file (NFC, white space to one
space, lower case, a split into letter runs, single digits and other runs, byte-level
BPE with word ends), so equal pre-tokens have equal ids wherever they stand.  Pre-tokens
made of ASCII and two-byte Latin letters are cut here, vectorised, and each distinct
one is encoded once by the library's model; a word with any other byte goes to the
whole tokenizer once.  Texts with a special token's string are encoded whole.  For a
file with other rules every text is encoded whole.  Distinct pre-tokens are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import LOWER, SPACE, SLICE, Words, buffers, slices

_ENTRIES = 1 << 20
_CLASS = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 for the whole tokenizer
_CLASS[33:127] = 3
_CLASS[np.flatnonzero(SPACE)] = 0
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 1
_CLASS[48:58] = 2
_CLASS[ord("'")] = 4  # contractions


class _Cache:
    """Open-addressing table from hash to a run of ids."""

    def __init__(self) -> None:
        self.slots = 1 << 16
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.ids = np.zeros(1 << 17, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out, mask = np.full(len(h), -1, np.int32), np.uint64(self.slots - 1)
        slot = (h & mask).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.entry[slot[hit]]
        rest = np.flatnonzero(~hit & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)
            key = self.keys[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.entry[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def _place(self, h: np.ndarray, entry: np.ndarray) -> None:
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.entry[slot[put]] = h[put], entry[put]
            left = np.ones(len(h), bool)
            left[put] = False
            rest = rest[left[rest]]
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        entry = np.arange(self.n, self.n + len(h), dtype=np.int32)
        while len(self.start) < self.n + len(h):
            self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.start[entry] = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.size[entry] = sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(h), self.used + len(ids)
        if 2 * self.n > self.slots:
            old = self.keys != 0
            h, entry = np.concatenate((self.keys[old], h)), np.concatenate((self.entry[old], entry))
            while 2 * self.n > self.slots:
                self.slots *= 2
            self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self._place(h, entry)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        split = [p.get("pattern", {}).get("Regex") for p in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.known = (
            [n["type"] for n in (rules.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and split[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
            and model.get("end_of_word_suffix") == "</w>"
        )
        self.special = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self.vocabulary = max(self.whole.get_vocab_size(), *(t["id"] + 1 for t in rules.get("added_tokens", [{"id": 0}])))
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        if self.known:
            self.last = np.zeros(self.vocabulary, bool)
            self.last[[i for w, i in model["vocab"].items() if w.endswith("</w>")]] = True
            self.plain = Tokenizer.from_str(json.dumps(rules | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None}))
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache = _Cache()

    def _direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], np.uint32)

    def _learn(self, raw: bytes, h: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> None:
        for some, fn in ((np.flatnonzero(~odd), self._plain), (np.flatnonzero(odd), self._direct)):
            for k in range(0, len(some), 4096):
                part = some[k : k + 4096]
                sizes, ids = fn([raw[a:b].decode() for a, b in zip(start[part].tolist(), end[part].tolist())])
                self.cache.add(h[part], sizes, ids)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.plain.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(words):  # a word without an end mark: not this kind of model
            return self._direct(words)
        return np.diff(ends, prepend=-1), ids

    def _slice(self, data: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data[at[0] : at[-1]].tobytes().translate(LOWER), np.uint8).copy()
        lead = np.flatnonzero(raw == 0xC3)
        kind = _CLASS[raw]
        if len(lead):
            next_ = raw[lead + 1]
            lead = lead[(next_ != 0x97) & (next_ != 0xB7)]
            kind[lead] = kind[lead + 1] = 1
            upper = lead[(raw[lead + 1] < 0x9F)] + 1
            raw[upper] += 0x20
        w = Words(raw, at - at[0], lower=False, hashed=False)
        n = len(raw)
        odd_before = np.concatenate(([0], np.cumsum(kind == 4)))
        odd = odd_before[w.end] > odd_before[w.start]
        if odd.any():
            inside = np.zeros(n + 1, np.int8)
            inside[w.start[odd]] += 1
            inside[w.end[odd]] -= 1
            kind[np.cumsum(inside[:n], dtype=np.int8) > 0] = 5
        edge = np.zeros(n + 1, bool)
        edge[w.offsets] = True
        turn = np.ones(n + 1, bool)
        turn[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        turn |= edge
        start = np.flatnonzero(turn[:n] & (kind != 0))
        end = np.flatnonzero(turn[1:] & (kind != 0)) + 1
        h = w.spans(start, end)
        h[h == 0] = 1
        if self.cache.n > _ENTRIES:
            self.cache = _Cache()
        entry = self.cache.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one = np.unique(h[missing], return_index=True)
            one = missing[one]
            self._learn(raw.tobytes(), h[one], start[one], end[one], kind[start[one]] == 5)
            entry[missing] = self.cache.find(h[missing])
        first = np.searchsorted(start, w.offsets)
        sizes = self.cache.size[entry].astype(np.int64)
        sizes, froms = np.insert(sizes, first[1:], 1), np.insert(self.cache.start[entry], first[1:], -1)
        before = np.concatenate(([0], np.cumsum(sizes)))
        marks = froms == -1
        froms[marks] = 0
        ids = self.cache.ids[np.repeat(froms - before[:-1], sizes) + np.arange(before[-1])]
        ends = before[1:][marks]
        ids[ends - 1] = end_id
        return ids.astype(self.dtype), np.concatenate(([0], ends))

    def encode(self, column: pa.Array, end_id: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, n + 1 offsets) for runs of rows; ``end_id`` ends each document."""
        data, at = buffers(column)
        for i, j in slices(at, SLICE):
            raw = data[at[i] : at[j]].tobytes()
            if self.known and not any(s in raw for s in self.special):
                yield i, *self._slice(data, at[i : j + 1], end_id)
            else:
                texts = [raw[at[k] - at[i] : at[k + 1] - at[i]].decode() for k in range(i, j)]
                for k, text in enumerate(texts):
                    _, ids = self._direct([text])
                    ids = np.append(ids, end_id).astype(self.dtype)
                    yield i + k, ids, np.array([0, len(ids)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process: its cache serves all tasks of a worker."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
