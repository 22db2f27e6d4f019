"""Binary token shards with a minimal perfect hash index from key to offset.

A shard holds the ids of a run of documents in ascending key order:

    16 bytes   b"LLIDS001", item size (u32), zero (u32)
    ids        little-endian unsigned 16 or 32 bits, documents one after another
    keys       i64 for each document (null keys first, as 0)
    offsets    i64 for each document and one more, in ids
    index      levels, ranks, fingerprints and ordinals (see ``build_index``)
    footer     JSON with the place of each section, its length (u32), b"LLIDS001"

The index hashes a key level by level; at the first level whose bit is set, the rank of
that bit is the key's slot, which has a 16-bit fingerprint and the ordinal of the key's
first document.  A lookup reads a constant number of places.  A manifest with each
shard's key range routes a key to its shard.

Null texts are documents with the end id alone.  Rows with equal keys stand side by
side in order of their texts' hashes; the index of a shard leads to the first of them
there.  Keys may take the whole range of 64-bit integers, and a key that many rows have is
spread over several shards (``ranges.py``).
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import find_cuts, with_shard
from .store import filesystem, remove_unfinished, saved, shared_dir
from .text import mix
from .tokens import encoder

MAGIC = b"LLIDS001"
_ENTRY = "shard int, file string, docs long, nulls long, ids long, first_key long, last_key long"
_ENTRY_PA = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("nulls", pa.int64()), ("ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())])


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1)))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 255) >> np.uint64(48)).astype(np.uint16)


def build_index(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Minimal perfect hash of distinct int64 ``keys``: slot i has key number ``ordinal[i]``."""
    levels, sizes, left = [], [], np.arange(len(keys))
    while len(left):
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = (_level_hash(keys[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        levels.append(np.packbits(bits, bitorder="little"))
        sizes.append(size)
        left = left[~alone]
    bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
    ones = np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1, dtype=np.int64)
    index = {"sizes": np.array(sizes, np.int64), "bits": bits, "ranks": np.concatenate(([0], np.cumsum(ones)))[:-1]}
    index |= {"ordinal": np.zeros(len(keys), np.uint32), "fingerprint": np.zeros(len(keys), np.uint16)}
    slot = _slots(index, keys)
    index["ordinal"][slot], index["fingerprint"][slot] = np.arange(len(keys)), _fingerprint(keys)
    return index


def _slots(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key (of any slot or -1 for a key that was not indexed)."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(index["sizes"].tolist()):
        if not len(left):
            break
        at = base + (_level_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
        hit = index["bits"][at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0
        at = at[hit]
        block = at >> 6
        word = index["bits"].view("<u8")[block]
        below = word & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        out[left[hit]] = index["ranks"][block] + np.bitwise_count(below)
        left, base = left[~hit], base + size
    return out


def lookup(index: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Ordinal for each key, -1 where the fingerprint shows that it is absent."""
    keys = np.ascontiguousarray(keys, np.int64)
    if not len(index["fingerprint"]):
        return np.full(len(keys), -1, np.int64)
    slot = _slots(index, keys)
    here = (slot >= 0) & (index["fingerprint"][slot] == _fingerprint(keys))
    return np.where(here, index["ordinal"][slot].astype(np.int64), -1)


class _Writer:
    def __init__(self, folder: str, name: str, dtype: np.dtype):
        self.fs, root = filesystem(folder)
        self.final, self.temp = f"{root}/{name}", f"{root}/_tmp-{uuid.uuid4().hex}-{name}"
        self.out, self.dtype = self.fs.open_output_stream(self.temp), dtype
        self.out.write(MAGIC + int(dtype.itemsize).to_bytes(4, "little") + bytes(4))
        self.keys, self.nulls, self.sizes = [], 0, []

    def add(self, keys: list, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.out.write(ids.astype(self.dtype, copy=False).tobytes())
        self.nulls += sum(k is None for k in keys)
        self.keys.append(np.array([k or 0 for k in keys], np.int64))
        self.sizes.append(np.diff(offsets))

    def commit(self) -> dict:
        keys, sizes = np.concatenate(self.keys), np.concatenate(self.sizes)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        real = keys[self.nulls :]
        firsts = np.flatnonzero(np.concatenate(([True], real[1:] != real[:-1]))) if len(real) else np.zeros(0, np.int64)
        index = build_index(real[firsts])
        index["ordinal"] = (firsts[index["ordinal"]] + self.nulls).astype(np.uint32)
        places = {"ids": [16, int(offsets[-1])]}
        at = 16 + int(offsets[-1]) * self.dtype.itemsize
        for name, a in {"keys": keys, "offsets": offsets, **index}.items():
            pad = -at % 8
            self.out.write(bytes(pad) + a.tobytes())
            places[name] = [at + pad, len(a), a.dtype.str]
            at += pad + a.nbytes
        foot = json.dumps(places | {"nulls": self.nulls}).encode()
        self.out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.final)
        return {"docs": len(keys), "nulls": self.nulls, "ids": int(offsets[-1]), "first_key": int(real[0]) if len(real) else None, "last_key": int(real[-1]) if len(real) else None}


class Shard:
    """A shard opened for reading; ids are read on demand."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 12)
        tail = self.file.read(12)
        n = int.from_bytes(tail[:4], "little")
        self.file.seek(size - 12 - n)
        self.places = json.loads(self.file.read(n))
        self.file.seek(0)
        head = self.file.read(16)
        if head[:8] != MAGIC or tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a whole shard")
        self.dtype = np.dtype("<u2" if head[8] == 2 else "<u4")
        self.nulls = self.places["nulls"]
        self.keys, self.offsets = self._section("keys"), self._section("offsets")
        self.index = {k: self._section(k) for k in ("sizes", "bits", "ranks", "ordinal", "fingerprint")}

    def _section(self, name: str) -> np.ndarray:
        at, n, dtype = self.places[name]
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(dtype).itemsize), dtype)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of documents ``first`` up to ``last`` (exclusive)."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        self.file.seek(16 + a * self.dtype.itemsize)
        return np.frombuffer(self.file.read((b - a) * self.dtype.itemsize), self.dtype)

    def get(self, key: int) -> np.ndarray | None:
        k = int(lookup(self.index, np.array([key]))[0])
        return self.ids(k, k + 1) if k >= 0 and self.keys[k] == key else None


def write_shards(df: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, shard_bytes: int | None = None) -> list[dict]:
    """Tokenize and write all rows; return the manifest's entries, in key order."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    sizes = rows.select("key", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size"))
    cuts = find_cuts(saved(sizes, shared_dir(df.sparkSession)), shard_bytes)
    dealt = with_shard(rows, cuts).repartitionById(cuts.shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "tie").select("key", "text", "shard")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard, out, entries = encoder(tokenizer), None, None, []
        for b in batches:
            keys, into = b.column(b.schema.names.index("key")).to_pylist(), b.column(b.schema.names.index("shard")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(into)) + 1).tolist(), len(into)] if len(into) else []
            for i, j in zip(edges, edges[1:]):
                if into[i] != shard:
                    if out:
                        entries.append({"shard": int(shard), "file": f"part-{shard:05d}.ids", **out.commit()})
                    shard = into[i]
                    out = _Writer(folder, f"part-{shard:05d}.ids", code.dtype)
                for k, ids, offsets in code.encode(b.column(b.schema.names.index("text")).slice(i, j - i), end_id):
                    out.add(keys[i + k : i + k + len(offsets) - 1], ids, offsets)
        if out:
            entries.append({"shard": int(shard), "file": f"part-{shard:05d}.ids", **out.commit()})
        if entries:
            yield pa.RecordBatch.from_pylist(entries, _ENTRY_PA)

    entries = sorted((r.asDict() for r in dealt.mapInArrow(write, _ENTRY).collect()), key=lambda e: e["shard"])
    start = 0
    for e in entries:
        e["start"], start = start, start + e["ids"]
    temp = f"{root}/_tmp-{uuid.uuid4().hex}-manifest.json"
    with fs.open_output_stream(temp) as f:
        f.write(json.dumps(entries).encode())
    fs.move(temp, f"{root}/manifest.json")
    remove_unfinished(fs, root)
    return entries


def manifest(folder: str) -> list[dict]:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


class TokenStore:
    """Keyed access to a written folder: two range checks, one index lookup, one read."""

    def __init__(self, folder: str):
        self.fs, self.root = filesystem(folder)
        self.entries = [e for e in manifest(folder) if e["first_key"] is not None]
        self.highs, self.open = [e["last_key"] for e in self.entries], {}

    def get(self, key: int) -> np.ndarray | None:
        k = bisect.bisect_left(self.highs, key)  # the first shard that may hold it
        if k == len(self.entries) or key < self.entries[k]["first_key"]:
            return None
        name = self.entries[k]["file"]
        if name not in self.open:
            self.open[name] = Shard(self.fs, f"{self.root}/{name}")
        return self.open[name].get(key)


_ROW_PA = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, folder: str, piece: int = 1 << 21) -> DataFrame:
    """Per document, from the files: key, start, n_tokens, ids_crc32.

    Every key is looked up by the index; a wrong place raises.
    """
    entries = [(i, e["file"], e["start"]) for i, e in enumerate(manifest(folder))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for _, name, start in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(fs, f"{root}/{name}")
                real = s.keys[s.nulls :]
                found = lookup(s.index, real)
                if len(real) and not ((found >= s.nulls) & (s.keys[found] == real)).all():
                    raise ValueError(f"{name}: the index misses a key")
                i, n = 0, len(s.keys)
                while i < n:
                    j = min(n, max(i + 1, int(np.searchsorted(s.offsets, s.offsets[i] + piece, "right")) - 1))
                    ids, at = s.ids(i, j).astype("<u4"), s.offsets[i : j + 1] - s.offsets[i]
                    view = memoryview(ids).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                    keys = pa.array(s.keys[i:j], mask=np.arange(i, j) < s.nulls)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(s.offsets[i:j] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=_ROW_PA)
                    i = j

    dealt = spark.createDataFrame(entries, "at int, file string, start long").repartitionById(max(1, len(entries)), F.col("at"))
    return dealt.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")
