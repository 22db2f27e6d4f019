"""Media columns: content-defined chunks, deduplicated, with ordered chunk lists.

A payload is cut where a rolling gear hash over the last 32 bytes has its top bits
zero, between ``smallest`` and ``largest`` bytes.  Chunk digests are counted by one
aggregation; a digest that occurs once keeps its bytes beside its chunk list, the
others go to a chunk table with one row for each digest.  A bitmap of the
repeated digests, with 256 bits for each and 64 MB at most, tells the storing pass which
chunks may be repeated; a false hit only puts a single chunk into the chunk table, so
nothing depends on the bitmap for being right.  Where it fills up, beyond some 10 million
repeated digests, more and more single chunks take the way through the chunk table, at
most one shuffle of all payloads.

Reading joins only the repeated chunks to the lists that name them, puts payloads
together in order and checks every chunk's digest and the whole length.

Null payloads are empty.  An empty payload is padded to one block of 64 zero bytes.
Equal payloads give equal rows; rows with equal or null keys stay separate rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bits_for, in_bitmap, key_bitmap, saved, shared_dir
from .text import buffers, slices

PAD = 64
_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint32)
_HEAD, _ENTRY = struct.Struct("<4sIQ"), struct.Struct("<I16s")
_STORED = "kind int, row long, key long, n long, list binary, body binary, refs array<struct<seq:int,digest:binary>>, digest binary"


def padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads with zeros appended up to a positive multiple of ``PAD``."""
    sizes = np.maximum(1, -(-np.diff(at) // PAD)) * PAD
    to = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(to[-1], np.uint8)
    for i in range(len(sizes)):
        out[to[i] : to[i] + at[i + 1] - at[i]] = data[at[i] : at[i + 1]]
    return out, to


def cuts(data: np.ndarray, at: np.ndarray, smallest: int = 512, average_bits: int = 11, largest: int = 8192) -> list[list[int]]:
    """For each payload the ends of its chunks, relative to its start.

    The hash window (32 bytes) is shorter than ``smallest``, so cuts depend on the
    payload alone and not on what stands before it in ``data``.
    """
    if not 32 <= smallest < largest:
        raise ValueError("need 32 <= smallest < largest")
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s) if len(h) > s else 0
    ends = np.flatnonzero(h >> np.uint32(32 - average_bits) == 0) + 1
    out = []
    for i in range(len(at) - 1):
        a, n = int(at[i]), int(at[i + 1] - at[i])
        own = ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + n, "right")] - a if n > smallest else ends[:0]
        done, got = 0, []
        while n - done > smallest:
            k = int(np.searchsorted(own, done + smallest))
            done = min(int(own[k]) if k < len(own) else n, done + largest, n)
            got.append(done)
        if done < n:
            got.append(n)
        out.append(got)
    return out


def _digest(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_lists(column: pa.Array, **sizes) -> Iterator[tuple[int, int, list[bytes], list[memoryview]]]:
    """(row, bytes without padding, digests, chunks) for each payload of a column."""
    data, at = buffers(column)
    for i, j in slices(at):
        body, to = padded(data, at[i : j + 1])
        view = memoryview(body)
        for k, ends in enumerate(cuts(body, to, **sizes)):
            chunks, a = [], 0
            for e in ends:
                chunks.append(view[to[k] + a : to[k] + e])
                a = e
            yield i + k, int(at[i + k + 1] - at[i + k]), [_digest(c) for c in chunks], chunks


def repeated_digests(df: DataFrame, payload: str, **sizes) -> DataFrame:
    """Every chunk digest that occurs more than once."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, int] = {}
            for _, _, names, _ in chunk_lists(b.column(0), **sizes):
                for d in names:
                    found[d] = found.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["digest", "copies"])

    counts = df.select(payload).mapInArrow(digests, "digest binary, copies long").groupBy("digest").agg(F.sum("copies").alias("copies"))
    return counts.where("copies > 1").select("digest")


def _low64(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def pack_list(digests: list[bytes], chunks: list) -> bytes:
    """The ordered chunk list of a payload."""
    return _HEAD.pack(b"CDC1", len(chunks), sum(map(len, chunks))) + b"".join(_ENTRY.pack(len(c), d) for c, d in zip(chunks, digests))


def store_media(df: DataFrame, folder: str, key: str = "doc_id", payload: str = "text", **sizes) -> None:
    """Write chunk lists (``folder/media``) and the chunk table (``folder/chunks``)."""
    spark = df.sparkSession
    low = F.expr("conv(hex(reverse(substring(digest, 1, 8))), 16, -10)").cast("long")
    repeated = saved(repeated_digests(df, payload, **sizes).select(low.alias("k")), shared_dir(spark))
    bitmap = spark.sparkContext.broadcast(key_bitmap(repeated, "k", bits_for(repeated.count(), 256)))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "row", "key", "n", "list", "body", "refs", "digest"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("seq", pa.int32()), ("digest", pa.binary())])), pa.binary()]
        row, sent = TaskContext.get().partitionId() << 36, set()
        for b in batches:
            keys, out, held = b.column(0).to_pylist(), [], 0

            def flush():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

            for i, n, digests, chunks in chunk_lists(b.column(1), **sizes):
                maybe = in_bitmap(bitmap.value, _low64(digests))
                listed = pack_list(digests, chunks)
                refs = [{"seq": s, "digest": digests[s]} for s in np.flatnonzero(maybe).tolist()]
                out.append((0, row, keys[i], n, listed, b"".join(c for c, m in zip(chunks, maybe) if not m), refs, None))
                row += 1
                for r in refs:
                    if r["digest"] not in sent:  # copies within the task go no further
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(r["digest"])
                        out.append((1, None, None, None, None, bytes(chunks[r["seq"]]), None, r["digest"]))
                held += n + 200
                if held > 8 << 20:
                    yield flush()
                    out, held = [], 0
            if out:
                yield flush()

    media = df.select(F.col(key).cast("long").alias("key"), F.col(payload).alias("payload")).mapInArrow(store, _STORED)
    media.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/media")
    staged = read_stored(spark, folder).where("kind = 1").select("digest", "body")
    staged.dropDuplicates(["digest"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunks")


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{folder}/media")


def rebuild(listed: bytes, inline: bytes, shared: dict[int, bytes]) -> bytes:
    """The payload of a chunk list, every chunk verified."""
    magic, count, total = _HEAD.unpack_from(listed)
    if magic != b"CDC1":
        raise ValueError("not a chunk list")
    out, a, view = [], 0, memoryview(inline)
    for s in range(count):
        n, digest = _ENTRY.unpack_from(listed, _HEAD.size + s * _ENTRY.size)
        if s in shared:
            chunk = shared[s]
        else:
            chunk = view[a : a + n]
            a += n
        if len(chunk) != n or _digest(chunk) != digest:
            raise ValueError("chunk differs from its digest")
        out.append(chunk)
    payload = b"".join(out)
    if len(payload) != total or a != len(inline):
        raise ValueError("payload length differs")
    return payload


def features(payload: bytes) -> str:
    """Level statistics of the samples: mean, deviation, roughness, entropy, peak."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x, minlength=256)
    level, p = np.arange(256), h[h > 0] / len(x)
    mean = float(h @ level) / len(x)
    spread = float(np.sqrt(max(0.0, float(h @ (level * level)) / len(x) - mean * mean)))
    rough = float(np.abs(np.diff(x.astype(np.int16))).sum()) / len(x)
    return f"{mean:.4f};{spread:.4f};{rough:.4f};{float(-(p * np.log2(p)).sum()):.4f};{int(h.argmax())}"


_RESULT = pa.schema([
    ("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_chunks", pa.int32()), ("payload", pa.binary()),
])
_RESULT_SQL = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int, payload binary"


def _described(key, n: int, listed: bytes, payload: bytes, keep: bool) -> tuple:
    media = hashlib.sha256(listed)
    media.update(payload)
    return (
        key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(listed) + len(payload), media.hexdigest(),
        features(payload), (len(listed) - _HEAD.size) // _ENTRY.size, payload if keep else None,
    )


def read_media(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Rebuild every payload from the stored rows and describe it.

    The stored form of a payload is its chunk list followed by its chunks in order.
    ``payloads=True`` also returns the bytes themselves.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by row and seq: the list (seq -1) first, then its shared chunks."""
        now, shared, out, held = None, {}, [], 0
        for b in batches:
            for row, seq, key, n, listed, body in zip(*(c.to_pylist() for c in b.columns)):
                if seq < 0:
                    if now:
                        out.append(_described(now[0], now[1], now[2], rebuild(now[2], now[3], shared), payloads))
                        held += len(now[3]) if payloads else 400
                    now, shared = (key, n, listed, body), {}
                else:
                    shared[seq] = body
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
        if now:
            out.append(_described(now[0], now[1], now[2], rebuild(now[2], now[3], shared), payloads))
        if out:
            yield batch(out)

    lists = read_stored(spark, folder).where("kind = 0")
    whole = lists.where("size(refs) = 0").select("row", F.lit(-1).alias("seq"), "key", "n", "list", "body").mapInArrow(together, _RESULT_SQL)
    parts = lists.where("size(refs) > 0")
    chunks = spark.read.schema("digest binary, body binary").parquet(f"{folder}/chunks")
    named = parts.select("row", F.explode("refs").alias("r")).select("row", "r.seq", "r.digest").join(chunks, "digest")
    none = F.lit(None)
    rows = parts.select("row", F.lit(-1).alias("seq"), "key", "n", "list", "body").unionByName(
        named.select("row", "seq", none.cast("long").alias("key"), none.cast("long").alias("n"), none.cast("binary").alias("list"), "body")
    )
    rows = rows.repartition("row").sortWithinPartitions("row", "seq")
    return whole.unionByName(rows.mapInArrow(together, _RESULT_SQL))
