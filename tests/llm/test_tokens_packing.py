import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafledger.llm import packing, shards
from leafledger.llm.queries import op5_token_index, op6_pattern_packing
from leafledger.llm.tokens import default_tokenizer, encoder

from . import docs

ODD = ["don't I'LL  'sup 'S x's", "café café Ấ ÀLA ×÷ ß", "a1b22 3.14,x", "<|endoftext|> hi", "　x y\u0085z", "\x1c\x1d a\x7f", " ́x", "İstanbul ΣΑΣ ﬁ"]


def ids_of(text):
    return encoder(default_tokenizer()).whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_library():
    texts = docs.TEXTS + ODD
    seen = 0
    for i, ids, at in encoder(default_tokenizer()).encode(pa.array(texts)):
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == ids_of(texts[i + k])
            seen += 1
    assert seen == len(texts)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_index(spark, path, texts):
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = ids_of(t)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op5_token_index(spark, path).collect())) == want


def test_index_awkward(spark, tmp_path):
    check_index(spark, docs.write(spark, tmp_path, docs.TEXTS + ODD), docs.TEXTS + ODD)


def test_index_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_index(spark, sf, [texts[i] for i in range(len(texts))])


def test_index_empty(spark, tmp_path):
    assert op5_token_index(spark, docs.write(spark, tmp_path, [])).count() == 0


def test_null_and_repeated_keys_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b b"), (9, None), (-4, "c")], "doc_id long, text string")
    shards.write_shards(df, f"file://{tmp_path}", default_tokenizer())
    rows = shards.read_shards(spark, f"file://{tmp_path}").orderBy("start").collect()
    assert [r.key for r in rows] == [None, -4, 3, 3, 9]
    store = shards.TokenStore(f"file://{tmp_path}")
    assert store.get(9).tolist() == [1] and store.get(-4).tolist() == ids_of("c") and store.get(4) is None and store.get(100) is None


def test_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    index = shards.build_index(keys)
    assert sorted(shards._slots(index, keys)) == list(range(len(keys)))
    assert (shards.lookup(index, keys) == np.arange(len(keys))).all()
    assert (shards.lookup(index, keys + 1) >= 0).mean() < 0.01


def test_cut_file_is_refused(tmp_path):
    from pyarrow import fs

    (tmp_path / "x.ids").write_bytes(b"LLIDS001" + bytes(40))
    with pytest.raises(ValueError):
        shards.Shard(fs.LocalFileSystem(), str(tmp_path / "x.ids"))


def check_packing(spark, path, texts, capacity=4096):
    rows = op6_pattern_packing(spark, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = ids_of(t)
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [(p, s, len(ids[s : s + capacity]), crc(ids[s : s + capacity])) for p, s in enumerate(range(0, len(ids), capacity))]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), sum(r.length for r in rows)


def test_packing_awkward(spark, tmp_path):
    check_packing(spark, docs.write(spark, tmp_path), docs.TEXTS)


def test_packing_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n, total = check_packing(spark, sf, [texts[i] for i in range(len(texts))])
    assert n <= -(-total // 4096) + 1


def test_packing_empty(spark, tmp_path):
    assert op6_pattern_packing(spark, docs.write(spark, tmp_path, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(4097, np.int64)
    lengths = np.minimum(4096, rng.lognormal(6 + seed / 2, 1.2, 30_000).astype(int) + 1)
    np.add.at(hist, lengths, 1)
    p = packing.plan(hist)
    assert not p.left.any() and (p.next == hist).all()
    filled = np.zeros(p.sequences, np.int64)
    spans = defaultdict(list)
    for length, rank, n, seq, offset in p.runs:
        filled[seq : seq + n] += length
        for s in range(seq, seq + n):
            spans[s].append((offset, length))
    assert filled.max() <= 4096
    assert all(a + n == b for own in spans.values() for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:]))
    assert p.sequences <= -(-filled.sum() // 4096) * 1.01 + max(0, (lengths > 2048).sum() - filled.sum() / 4096) + 1
    if len(np.flatnonzero(hist)) > 3000:
        assert p.sequences > 0


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    a, b = rng.random((12, 40)), rng.normal(size=12)
    x = packing.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and g.max() < 1e-6 and abs(g[x > 0]).max() < 1e-6


def test_index_with_wide_and_hot_ids(spark, tmp_path):
    rows = [(-(2**63), "a"), (2**63 - 1, "b"), (-7 * 10**18, "c"), (7 * 10**18, "d"), (0, "e"), (None, "f")]
    rows += [(42, f"hot {i} " * 50) for i in range(80)] + [(43, "equal " * 80)] * 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    entries = shards.write_shards(df, f"file://{tmp_path}", default_tokenizer(), shard_bytes=4_000)
    assert sum(e["docs"] for e in entries) == len(rows) and max(e["docs"] for e in entries) < 30
    got = shards.read_shards(spark, f"file://{tmp_path}").orderBy("start").collect()
    keys = [r.key for r in got]
    assert keys[0] is None and keys[1:] == sorted(r[0] for r in rows if r[0] is not None)
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(ids_of(t)), crc(ids_of(t))) for _, t in rows)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    store = shards.TokenStore(f"file://{tmp_path}")
    assert all(store.get(k).tolist() == ids_of(t) for k, t in rows if k not in (None, 42)) and store.get(42).tolist() in [ids_of(t) for k, t in rows if k == 42]
    assert store.get(41) is None


def test_dealing_depends_on_rows_alone(spark):
    from leafledger.llm import ranges

    rows = [(i * 7919 % 1000, i, 100 + i % 50) for i in range(3000)]
    a, b = (ranges.find_cuts(spark.createDataFrame(rows, "key long, tie long, size long").repartition(n), 5_000) for n in (2, 7))
    assert (a.begin == b.begin).all() and (a.first == b.first).all() and a.shards > 30


def test_packing_mostly_whole_sequences_and_a_hot_key(spark):
    long = " ".join(f"w{i % 50}" for i in range(12_000))
    rows = [(i % 3, long) for i in range(40)] + [(7, "the same short text")] * 60 + [(-(2**63), "x y"), (2**63 - 1, None), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cut = packing.saved(packing.pieces(df, default_tokenizer()), packing.shared_dir(spark))
    got = packing.pack(cut, group=7).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t in rows)
    assert sum(r.length == 4096 for r in got) >= 0.8 * sum(r.length > 20 for r in got)
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) <= -(-sum(r.length for r in got) // 4096) + 40
