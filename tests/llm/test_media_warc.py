import hashlib
import zlib

import pytest

from leafledger.llm import media, warc
from leafledger.llm.queries import op1_media_chunks, op10_warc

from . import docs


def expected_media(texts):
    out = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pay = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        out[i] = (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    return out


def check_media(spark, path, texts):
    got = op1_media_chunks(spark, path).collect()
    assert len(got) == len(texts)
    want = expected_media(texts)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id]
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id] or "", set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_awkward_documents(spark, tmp_path):
    check_media(spark, docs.write(spark, tmp_path), docs.TEXTS)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_media(spark, sf, [texts[i] for i in range(len(texts))])


def test_empty_table(spark, tmp_path):
    assert op1_media_chunks(spark, docs.write(spark, tmp_path, [])).count() == 0


def test_chunks_survive_an_insertion():
    import pyarrow as pa

    text = docs.LONG
    a, b = (set(next(media.chunk_lists(pa.array([t])))[2]) for t in (text, text[:1000] + "inserted" + text[1000:]))
    assert len(a & b) > 0.8 * len(a)


def test_damage_is_found():
    import pyarrow as pa

    _, n, digests, chunks = next(media.chunk_lists(pa.array([docs.LONG])))
    listed = media.pack_list(digests, chunks)
    body = b"".join(chunks)
    assert media.rebuild(listed, body, {}).startswith(docs.LONG.encode())
    with pytest.raises(ValueError):
        media.rebuild(listed, b"?" + body[1:], {})


def pages_oracle(rows):
    last = {}
    for k, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and k is not None:
            last[raw] = max(last.get(raw, k), k)
    out = []
    for k, h in rows:
        raw = (h or "").encode()
        to = last.get(raw, k)
        again = k is not None and to != k
        out.append((k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def pages(spark, path, rows):
    spark.createDataFrame([(k, f"http://x/{k} y\n", h, 1) for k, h in rows], "page_id long, url string, html string, key int").repartition(3).write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_warc_awkward(spark, tmp_path):
    big = "é" * 600
    rows = [(1, big), (5, big), (3, big), (5, big), (9, None), (8, ""), (7, "small"), (6, "small"), (None, big), (None, "q"), (20, "z" * 300_000), (21, "z" * 300_000), (2, "\r\n\r\n" * 400)]
    got = op10_warc(spark, pages(spark, tmp_path, rows))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == pages_oracle(rows)


def test_warc_table_rolls_and_repeats(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    a = warc.write_warc(df, f"file://{tmp_path}/a", file_bytes=20_000)
    b = warc.write_warc(df.repartition(7), f"file://{tmp_path}/b", file_bytes=20_000)
    assert a == b and len(a) > 2 and sum(e["records"] for e in a) == df.count()
    back = {r.key: bytes(r.payload) for r in warc.read_warc(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()}
    assert all(back[r.page_id].decode() == r.html for r in df.collect() if r.page_id in back)


def test_warc_empty(spark, tmp_path):
    assert op10_warc(spark, pages(spark, tmp_path, [])).count() == 0


def test_truncated_file_is_found(tmp_path):
    import gzip
    import io

    z = gzip.compress(b"a" * 1000)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(z[:-10])))


def test_warc_wide_and_hot_ids(spark, tmp_path):
    low, high = -(2**63), 2**63 - 1
    rows = [(low, "a" * 1500), (high, "a" * 1500), (0, "a" * 1500), (-7 * 10**18, "b"), (7 * 10**18, "c" * 2000), (None, "c" * 2000)]
    rows += [(42, f"{i} " * 400) for i in range(60)] + [(42, "same " * 300)] * 60 + [(high, "same " * 300)]
    df = spark.read.parquet(pages(spark, tmp_path, rows) + "/pages.parquet")
    entries = warc.write_warc(df, f"file://{tmp_path}/w", shard_bytes=10_000)
    got = warc.read_warc(spark, f"file://{tmp_path}/w", payloads=False)
    assert sorted((tuple(r) for r in got.select("key", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == pages_oracle(rows)
    assert max(e["records"] for e in entries) < 40
    ids = []
    for e in entries:
        with open(f"{tmp_path}/w/{e['file']}", "rb") as f:
            ids += [warc.parse(m)["id"] for m in warc.members(f)]
    assert len(set(ids)) == len(ids) == len(rows)


def test_warc_leftovers_go(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "_tmp-broken").write_bytes(b"x")
    warc.write_warc(spark.read.parquet(pages(spark, tmp_path, [(1, "a")]) + "/pages.parquet"), f"file://{tmp_path}/w")
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_tmp-")]


def test_warc_file_is_gzip_of_http_responses(spark, tmp_path):
    import gzip

    (e,) = warc.write_warc(spark.read.parquet(pages(spark, tmp_path, [(5, "<p>é</p>")]) + "/pages.parquet"), f"file://{tmp_path}/w")
    with gzip.open(f"{tmp_path}/w/{e['file']}") as f:
        head, http, body, end = f.read().split(b"\r\n\r\n", 3)
    assert head.startswith(b"WARC/1.1\r\n") and http.startswith(b"HTTP/1.1 200 OK\r\n") and body.decode() == "<p>é</p>" and end == b""
