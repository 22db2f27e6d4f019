import random
import re

import numpy as np
import pytest

from leafledger.llm import neardup
from leafledger.llm.components import UnionFind, components
from leafledger.llm.neardup import near_duplicates
from leafledger.llm.queries import op3_superminhash

from . import docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    uf = UnionFind(len(texts))
    owner = {}
    for i, s in enumerate(sets):
        if s:
            uf.join(i, owner.setdefault(s, i))
    reps = sorted(owner.values())
    for x, a in enumerate(reps):
        for b in reps[:x]:
            if 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    uf.join(a, b)
    return {i: (len(sets[i]), uf.root(i), uf.root(i) == i) for i in range(len(texts))}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_awkward(spark, tmp_path):
    got = result(op3_superminhash(spark, docs.write(spark, tmp_path)))
    assert got == brute(docs.TEXTS, 3, 85)


def test_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert result(op3_superminhash(spark, sf)) == brute([texts[i] for i in range(len(texts))], 3, 85)


def test_empty(spark, tmp_path):
    assert op3_superminhash(spark, docs.write(spark, tmp_path, [])).count() == 0


def test_large_group_of_near_copies_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 40 + [" ".join(rng.choice(base) for _ in range(50)) for _ in range(30)]
    got = near_duplicates(docs.frame(spark, texts), k=3, percent=85, block=32)
    assert result(got) == brute(texts, 3, 85)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, True), (None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.sort(pool[:700]), np.sort(pool[100:800])
    est = []
    for t in range(40):
        x = a + np.uint64(t * 7919)
        y = b + np.uint64(t * 7919)
        s = neardup.superminhash(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
        est.append((s[0] == s[1]).mean())
    assert abs(np.mean(est) - 0.75) < 0.02


@pytest.mark.parametrize("n", [1, 2, 7, 124, 126, 3000])
def test_superminhash_layers_equal_plain_algorithm(n):
    m = 125
    h = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    want = [None] * m
    for e in h:
        p = list(range(m))
        for j in range(m):
            bits = int(neardup._draw(np.array([e]), j)[0])
            k = j + ((bits >> 40) * (m - j) >> 24)
            p[j], p[k] = p[k], p[j]
            v = (bits & 0xFFFFFF) | j << 24
            want[p[j]] = v if want[p[j]] is None else min(want[p[j]], v)
        if n > 500 and j > 3:
            break
    if n <= 500:
        assert neardup.superminhash(h, np.array([0, n]))[0].tolist() == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    uf = UnionFind(2000)
    for a, b in edges:
        uf.join(a, b)
    want = {v: uf.root(v) for e in edges for v in e if uf.root(v) != v}
    from leafledger.llm.store import shared_dir

    shared_dir(spark)
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_smallest_and_largest_ids(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(low, "a b c d e f g h"), (high, "a b c d e f g h"), (0, "a b c d e f g h"), (5, docs.LONG), (high - 1, docs.LONG + " tail")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(df, k=3, percent=85).collect()}
    assert got == {low: (low, True), high: (low, False), 0: (low, False), 5: (5, True), high - 1: (5, False)}


def test_equal_ids_with_different_texts(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta " * 3, docs.BODY, docs.LONG)
    rows = [(5, a), (7, a), (7, b), (9, b), (9, c), (11, c + " tail"), (13, "quite another text of some words")]
    for n in (1, 4):
        got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), k=3, percent=85).collect())
        assert got == [(5, 5, True), (7, 5, False), (7, 5, False), (9, 5, False), (9, 5, False), (11, 5, False), (13, 13, True)]


def test_hot_id_with_different_texts(spark):
    rng = random.Random(5)
    texts = [docs.BODY + f" {rng.randrange(9)} {i}" for i in range(300)]
    df = spark.createDataFrame([(1, t) for t in texts] + [(2, texts[7]), (3, "some other words stand here alone")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(df, k=3, percent=85, block=32).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_large_groups_that_stay_apart_in_part(spark):
    """Copies of a few templates that share bands but not enough: several components in one candidate group."""
    rng, texts = random.Random(8), []
    base = [f"w{i}" for i in range(160)]
    for share in (0, 14, 22, 30):
        own = base[share:] + [f"t{share}x{i}" for i in range(share)]
        for _ in range(90):
            w = list(own)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    want = brute(texts, 3, 85)
    for fan_out in (1, 3, 100):
        assert result(near_duplicates(docs.frame(spark, texts), k=3, percent=85, block=16, fan_out=fan_out)) == want


def test_without_a_bitmap_the_same(spark, sf, monkeypatch):
    from leafledger.llm import store

    whole = result(near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")))
    monkeypatch.setattr(store, "MOST_BITS", 1 << 4)
    assert result(near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))) == whole


def test_only_candidates_move(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id as key", "text")
    signed = neardup.signatures(rows, 5)
    wanted = signed.where("set is not null and key % 10 = 0").select("key", "set")
    n = wanted.count()
    assert neardup.candidate_sets(rows, 5, wanted).count() == n
