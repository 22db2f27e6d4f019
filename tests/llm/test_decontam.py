import random
import re

import pytest

from leafledger.llm import decontam
from leafledger.llm.queries import op4_decontamination

from . import docs

ITEM = "In which year did the heron council of Varmland agree to drain the seven salt ponds near Orrefors and move every lantern keeper to the north shore? It was settled in eighteen forty two."
PARAPHRASE = "In what year had the heron council of Varmland agreed to drain those seven salt ponds near Orrefors and move each lantern keeper to a north shore? It was settled in eighteen forty two."
OTHER = "A steam ferry carries cheese, nails and two patient goats across the sound on Mondays unless fog hides the outer beacon."


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, key int")


def filler(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alder birch cedar drift ember flint grove heath inlet jetty knoll ledge marsh north otter".split()) for _ in range(n))


def test_planted(spark, tmp_path):
    texts = [filler(1, 300) + " " + ITEM + " " + filler(2, 300), ITEM.upper(), PARAPHRASE + " " + filler(3, 40), filler(4, 500), ITEM[: len(ITEM) // 3] + filler(5, 60), OTHER.replace(" ", "\n\t"), None, "", docs.LONG]
    path = docs.write(spark, tmp_path, texts, benchmark=bench(spark, [(7, ITEM, 1), (8, OTHER, 1), (9, None, 1), (None, OTHER, 1), (11, ITEM, 1), (12, "...", 1)]))
    got = {(r.doc_id, r.item_id): r for r in op4_decontamination(spark, path).collect()}
    assert set(got) == {(d, i) for d in (0, 1, 2) for i in (7, 11)} | {(5, 8), (5, None)}
    assert got[0, 7].coverage == 1 and (got[0, 7].start_word, got[0, 7].end_word) == (300, 300 + got[0, 7].item_words)
    assert got[2, 7].coverage < 1 and got[2, 7].answer_found


def test_stray_words_around_do_not_hide_a_copy(spark, tmp_path):
    short = "Which otter counted nine brass kettles under the old pier before Yule came to Orrefors"  # 15 words
    cut = " ".join(short.split()[:13])
    stray = "granite pebble signal walnut copper velvet saddle lantern meadow timber violet barrel candle hammer"
    edited = (short.replace("brass", "tin"), short.replace("pier", "quay").replace("nine", "six"))
    texts = [f"{cut} {stray} pebble signal walnut copper to {stray}", f"{stray} {edited[0]} {' '.join(stray.split()[:3])} {edited[1]} {stray}", f"{' '.join(short.split()[:8])} {stray} {stray} {' '.join(short.split()[8:])}"]
    path = docs.write(spark, tmp_path, texts, benchmark=bench(spark, [(7, short, 1)]))
    got = {r.doc_id: r for r in op4_decontamination(spark, path).collect()}
    assert set(got) == {0, 1}
    assert (got[0].common_words, got[0].start_word, got[0].end_word) == (13, 0, 13)
    assert got[1].common_words == 14 and (got[1].start_word, got[1].end_word) == (14, 29)


def test_table_equals_search_for_whole_items(spark, sf):
    norm = lambda s: " " + " ".join(re.findall(r"[^\W_]+", s.lower())) + " "
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, n in items.items() if n in t}
    got = {(r.doc_id, r.item_id) for r in op4_decontamination(spark, sf).collect()}
    assert want <= got and len(got - want) <= 0.05 * len(want) + 1


def test_empty(spark, tmp_path):
    assert op4_decontamination(spark, docs.write(spark, tmp_path / "a", [], benchmark=bench(spark, [(1, ITEM, 1)]))).count() == 0
    assert op4_decontamination(spark, docs.write(spark, tmp_path / "b", docs.TEXTS, benchmark=bench(spark, []))).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch, sf):
    documents, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    pairs = lambda: {(r.doc_id, r.item_id) for r in decontam.contaminated(documents, items).collect()}
    whole = pairs()
    monkeypatch.setattr(decontam, "BLOCK", 30)
    assert pairs() == whole


@pytest.mark.parametrize("seed", range(30))
def test_lcs(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert decontam.lcs(a, b) == row[-1]


def test_cosine_candidates_against_brute_force(spark, sf):
    """Every (passage, item) pair that the words confirm, and how many of these the latent search proposes."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    documents = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect() if r.text]
    other = [w for t in documents for w in t.split()]
    chosen = [i for i, t in items.items() if 12 <= len(t.split())][:60]
    edited = [" ".join(rng.choices(other, k=rng.randrange(90)) + [x if rng.random() < 0.72 else rng.choice(other) for x in items[i].split()] + rng.choices(other, k=70)) for i in chosen]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(documents + edited)], "key long, text string")
    own = decontam.Items(list(items), list(items.values()), [" ".join(t.split()[:2]) for t in items.values()], 24, 5)
    (found,) = decontam.frequencies(texts.select("text"), [spark.sparkContext.broadcast(own)], 24)
    own.weigh(*found)
    own.index(decontam.latent_basis(own, texts.select("text"), 24, 128, 3))
    data, at = decontam.buffers(pa.array(edited))
    w = decontam.words_of(data, at)
    proposed = {(d, k) for d, k, _, _ in own.search(w, 0.6)}
    want = set()
    for d in range(len(edited)):
        words = w.hash[w.first[d] : w.first[d + 1]].tolist()
        for k, (item, _) in enumerate(own.passages):
            for first in range(0, len(words), 24):
                if own.confirm(k, words, first, 0.6, 0.6):
                    want.add((d, item))
    got = {(d, own.passages[k][0]) for d, k in proposed} & want
    assert len(want) >= 30 and len(got) >= 0.9 * len(want), (len(want), len(got))
    # nothing but the cosine decides: the same pairs by one product of whole vectors
    u = own.basis * own.idf[:, None]
    for d, k, first, near in list(own.search(w, 0.6))[:50]:
        words = w.hash[w.first[d] : w.first[d + 1]][first : first + 48]
        v = u[own.terms(words)[own.terms(words) >= 0]].sum(0)
        assert abs(v @ own.latent[k] / np.linalg.norm(v) - near) < 1e-3


def test_basis_spans_the_leading_directions(spark):
    import numpy as np

    rng = random.Random(4)
    vocabulary = [f"term{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary[:30] if i % 2 else vocabulary[30:], k=24)) for i in range(80)]
    items = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(10)] + [" ".join(vocabulary)]
    own = decontam.Items(list(range(11)), items, [None] * 11, 24, 5)
    own.weigh(np.ones(len(own.vocabulary)), 100)
    part = spark.createDataFrame([(t,) for t in texts], "text string")
    basis = decontam.latent_basis(own, part, 24, 5, 6)

    def dense(rows):
        a = np.zeros((len(rows), len(own.vocabulary)))
        for i, r in enumerate(rows):
            for t in r:
                a[i, t] += own.idf[t]
        return a / np.linalg.norm(a, axis=1, keepdims=True)

    import pyarrow as pa

    w = decontam.words_of(*decontam.buffers(pa.array(texts)))
    s = dense([own.terms(w.hash[w.first[i] : w.first[i + 1]]) for i in range(len(texts))])
    b = dense([own.number[i][a : a + 48] for i, a in own.passages])
    whole = s.T @ s + b.T @ b * len(s) / len(b)
    exact = np.linalg.eigh(whole)[1][:, ::-1][:, :5]
    assert np.trace(basis.T @ whole @ basis) > 0.999 * np.trace(exact.T @ whole @ exact)


def test_repeated_and_null_ids(spark, tmp_path):
    d = spark.createDataFrame([(None, ITEM), (5, ITEM), (5, ITEM), (5, "other words"), (6, filler(2, 50))], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    bench(spark, [(7, ITEM, 1), (7, ITEM, 2)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r.item_id) for r in op4_decontamination(spark, str(tmp_path)).collect() if r.doc_id) == [(5, 7)]


def test_products_and_basis_take_all_documents(spark, monkeypatch):
    """The index of many documents is that of all their passages, and sums written in between add up."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    terms = [f"term{i}" for i in range(40)]
    item = " ".join(terms)
    texts = [" ".join(rng.choices(terms[:25] if i % 2 else terms[15:], k=24)) for i in range(6000)]
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6000, item)], "doc_id long, text string")
    indexed, index = [], decontam.Items.index
    monkeypatch.setattr(decontam.Items, "index", lambda self, basis: (indexed.append((self, basis)), index(self, basis))[1])
    decontam.contaminated(documents, bench(spark, [(7, item, 1)]), rank=2, power=8).collect()
    ((own, basis),) = indexed

    def dense(rows):
        a = np.zeros((len(rows), len(own.vocabulary)))
        for i, r in enumerate(rows):
            for t in r:
                a[i, t] += own.idf[t]
        return a / np.linalg.norm(a, axis=1, keepdims=True)

    w = decontam.words_of(*decontam.buffers(pa.array(texts + [item])))
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(6001)]
    s = dense([own.terms(x[k : k + 24]) for x in words for k in range(0, len(x), 24)])
    b = dense([own.number[i][a : a + 48] for i, a in own.passages])
    exact = np.linalg.eigh(s.T @ s + b.T @ b * len(s) / len(b))[1][:, ::-1][:, :2]
    assert np.linalg.svd(basis.T @ exact)[1].min() > 1 - 1e-6

    monkeypatch.setattr(decontam, "PAIRS", 50)
    found = decontam.products(documents.select("text"), [spark.sparkContext.broadcast(own)], 24).collect()
    got = np.zeros((len(own.vocabulary),) * 2)
    for r in found:
        if r.i >= 0:
            got[r.i, r.j] += r.x
    assert len({(r.i, r.j) for r in found}) == len(found) and [r.x for r in found if r.i < 0] == [len(s)]
    assert np.allclose(got, s.T @ s)
