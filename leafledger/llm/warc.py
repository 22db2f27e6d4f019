"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by runs of (key, payload hash) with about equal bytes
(``ranges.py``) and sorted; every partition writes gzip files that are rolled by
compressed size.  File names, headers and bytes depend on the input alone, so an attempt
that is run again writes the same file: it goes to a temporary name first and is then
renamed.  A manifest, renamed into place last, commits the archive; readers look only at
the files that it lists, and left-overs of broken attempts are deleted then.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the largest
key is the response, an HTTP message, and the others are revisits without a body.  Null payloads are empty; a null key sorts first and is
never a revisit; rows with the same key and the same payload are all responses when that
key is the largest.  Keys may take the whole range of 64-bit integers.  Record ids name
key, payload digest and a running number of such rows, so repeated rows have different
ids; a revisit refers to number 0.  If rows equal in key and payload fill more than a
shard, which of them goes to which shard follows from their places in the input.  An
empty table gives an archive without files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import find_cuts, with_interval, with_shard
from .store import filesystem, remove_unfinished, saved, shared_dir
from .text import buffers

_ENTRY = "file string, records long, bytes long, first_key long, last_key long, sha1 string"
_READ = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record_id(key, digest: str, number: str) -> str:
    return f"<urn:x-page:{'' if key is None else key}:{digest}:{number}>"


def _record(key, url: str, payload: memoryview, digest: str, number: str, target, date: str) -> bytes:
    """The bytes of one record, headers made anew."""
    block = b""
    if target is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + bytes(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if target is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(key, digest, number)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if target is not None:
        head += [f"WARC-Refers-To: {_record_id(target, digest, '0')}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive file: written under a temporary name, renamed when whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.name, self.final, self.temp = name, f"{root}/{name}", f"{root}/_tmp-{uuid.uuid4().hex}-{name}"
        self.out, self.size, self.records, self.sha1 = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
        self.first = self.last = None

    def add(self, key, record: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = z.compress(record) + z.flush()
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)
        self.records += 1
        self.first = key if self.first is None else self.first
        self.last = key if key is not None else self.last

    def commit(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return {"file": self.name, "records": self.records, "bytes": self.size, "first_key": self.first, "last_key": self.last, "sha1": self.sha1.hexdigest()}


def write_warc(
    df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
    min_revisit: int = 1000, file_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z", shard_bytes: int | None = None,
) -> list[dict]:
    """Write the archive below ``folder``; return the manifest's entries (one for each file)."""
    work = shared_dir(df.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(bytearray()))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("tie", F.xxhash64("digest"))
    facts = saved(rows.select("key", "tie", "digest", F.octet_length("payload").cast("long").alias("n")), f"{work}/facts")
    large = facts.where(F.col("n") >= min_revisit).select("key", "tie", "digest")
    groups = saved(large.groupBy("digest").agg(F.max("key").alias("target"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), f"{work}/groups")
    marks = large.join(groups, "digest").where("key <> target").distinct()
    cuts = find_cuts(facts.select("key", "tie", (F.col("n") + 512).alias("size")), shard_bytes)
    marks = with_interval(marks, cuts).withColumn("shard", F.explode(F.sequence("first", F.col("first") + F.col("width") - 1))).drop("width")
    both = with_shard(rows, cuts).withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(cuts.shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "tie", "digest", F.col("mark").desc(), F.xxhash64("url"))
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, entries, shard, roll, at, number, to = None, [], None, 0, None, 0, None
        for b in batches:
            data, offsets = buffers(b.column(b.schema.names.index("payload")))
            view = memoryview(data)
            keys, urls, digests, into, mark, first, part = (b.column(b.schema.names.index(c)).to_pylist() for c in ("key", "url", "digest", "target", "mark", "first", "shard"))
            for i in range(b.num_rows):
                if part[i] != shard:
                    if file:
                        entries.append(file.commit())
                    file, shard, roll, at = None, part[i], 0, None
                if (keys[i], digests[i]) != at:
                    at, number, to = (keys[i], digests[i]), 0, None
                if mark[i]:
                    to = into[i]
                    continue
                if file is None:
                    file = _File(folder, f"part-{shard:06d}-{roll:05d}.warc.gz")
                named = str(number) if shard == first[i] else f"{shard - first[i]}.{number}"
                file.add(keys[i], _record(keys[i], urls[i] or "", view[offsets[i] : offsets[i + 1]], digests[i].hex(), named, to, date))
                number += 1
                if file.size >= file_bytes:
                    entries.append(file.commit())
                    file, roll = None, roll + 1
        if file:
            entries.append(file.commit())
        if entries:
            yield pa.RecordBatch.from_pylist(entries, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("sha1", pa.string())]))

    entries = sorted((r.asDict() for r in dealt.mapInArrow(write, _ENTRY).collect()), key=lambda e: e["file"])
    temp = f"{root}/_tmp-{uuid.uuid4().hex}-manifest.json"
    with fs.open_output_stream(temp) as out:
        out.write("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode())
    fs.move(temp, f"{root}/manifest.json")
    remove_unfinished(fs, root)
    return entries


def manifest(folder: str) -> list[dict]:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return [json.loads(line) for line in f.read().decode().splitlines()]


def members(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """Each gzip member of a file, decompressed, reading a piece at a time."""
    z, out, left = zlib.decompressobj(31), [], b""
    while True:
        piece = left or stream.read(size)
        if not piece:
            if out:
                raise ValueError("truncated archive")
            return
        out.append(z.decompress(piece))
        left = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(record: bytes) -> dict:
    """Fields of one record; the payload's digest and length are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(field["Content-Length"])
    block = rest[:length]
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("bad record length")
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != field["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    body = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(field["X-Payload-Length"])):
        raise ValueError("payload digest differs")
    number = lambda s: int(x) if (x := s.split(":")[2]) else None
    return {
        "id": field["WARC-Record-ID"], "key": number(field["WARC-Record-ID"]), "url": field["WARC-Target-URI"], "record_type": kind, "payload_bytes": int(field["X-Payload-Length"]),
        "payload_digest": digest, "refers_to": number(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None, "payload": body if kind == "response" else None,
    }


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of a committed archive; a task for each file, a record at a time."""
    files = [(i, e["file"]) for i, e in enumerate(manifest(folder))]
    names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * payloads]
    types = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    types = pa.schema([types.field(n) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for b in batches:
            for name in b.column(1).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        rows.append(parse(record))
                        held += len(record) if payloads else 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    schema = _READ if payloads else _READ.rpartition(", ")[0]
    dealt = spark.createDataFrame(files, "at int, file string").repartitionById(max(1, len(files)), F.col("at"))
    return dealt.mapInArrow(read, schema)
