"""The vectorised models against plain Kneser-Ney over dictionaries."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from leafledger.llm import toxicity as tox

TOXIC = ["You utter ZZGRIM fool", "zzgrim  zzgrot\n\tagain", "such a zzgrot, zzgrim day", "é zzgrim"]
ORDINARY = ["A quiet day by the river", "such a day, such a river", "é", "", "the the the", "by the fool river"]


def _words(low):
    out, before = [], True
    for c in low:
        space = c == 32 or 9 <= c <= 13
        if not (space and before):
            out.append(b" " if space else bytes([c]))
        before = space
    return out


def grams(text):
    body = b"".join(_words(bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())))
    padded = b" " * (tox.ORDER - 1) + body
    return [padded[i : i + tox.ORDER] for i in range(len(body))]


def ends(text):
    return {g[-k:] for g in grams(text) for k in range(1, tox.ORDER + 1)}


def count(texts):
    out = Counter()
    for t in texts:
        out.update(ends(t))
    return out


def number(gram):
    return int.from_bytes(gram, "big")


def discounted(gram, counts, base):
    same = [n for g, n in counts.items() if len(g) == len(gram) and g[:-1] == gram[:-1] and n]
    if not same:
        return base
    return math.log(max(counts[gram] - tox.DISCOUNT, 0) / sum(same) + tox.DISCOUNT * len(same) / sum(same) * math.exp(base))


def plain(toxic, ordinary, share):
    """(toxic, ordinary) log-probabilities of every known n-gram, one n-gram at a time."""
    known = sorted(set(toxic) | set(ordinary), key=len)
    longer = Counter(g[1:] for g in known if len(g) > 1)
    both = Counter({g: longer[g] if len(g) < tox.ORDER else toxic[g] + ordinary[g] for g in known})
    pooled, ratio, out = {}, {}, {}
    for g in known:
        base, less = (pooled[g[1:]], ratio[g[1:]]) if len(g) > 1 else (math.log(1 / 256), 0.0)
        base_o = base - math.log(share * math.exp(less) + 1 - share)
        pooled[g] = discounted(g, both, base)
        step = discounted(g, toxic, base_o + less) - discounted(g, ordinary, base_o) - less
        error = math.sqrt(1 / (toxic[g] + 0.5) + 1 / (ordinary[g] + 0.5))
        ratio[g] = max(tox.LEAST, less + math.copysign(max(0, abs(step) - tox.CAUTION * error), step))
        log_o = pooled[g] - math.log(share * math.exp(ratio[g]) + 1 - share)
        out[g] = (log_o + ratio[g], log_o)
    return out


def test_grams_equal_plain_ones():
    texts = TOXIC + ORDINARY + ["  lead and trail \n", "\x00a\x0bb", "x"]
    keys, doc = tox._grams(*tox.buffers(pa.array(texts)))
    got = defaultdict(list)
    for k, d in zip(keys.tolist(), doc.tolist()):
        got[d].append(k)
    assert all(got[i] == [number(g) for g in grams(t)] for i, t in enumerate(texts))


def test_likelihoods_equal_plain_kneser_ney():
    toxic, ordinary = count(TOXIC * 3), count(ORDINARY)
    known = sorted(set(toxic) | set(ordinary))
    share = 3 * len(TOXIC) / (3 * len(TOXIC) + len(ORDINARY))
    model = tox.Model(np.array([number(g) | len(g) << 48 for g in known], np.uint64), np.array([toxic[g] for g in known]), np.array([ordinary[g] for g in known]), share)
    log = plain(toxic, ordinary, share)

    def of(gram):
        return next((log[gram[-k:]] for k in range(tox.ORDER, 0, -1) if gram[-k:] in log), (math.log(1 / 256),) * 2)

    assert any(a - b > 0.1 for a, b in log.values()) and any(a - b < -0.1 for a, b in log.values())
    texts = TOXIC + ORDINARY + ["something not seen at all: zzgrim QXJ"]
    for i, a, b in model.likelihoods(pa.array(texts)):
        for k in range(len(a)):
            own = [of(g) for g in grams(texts[i + k])]
            want = [sum(x[c] for x in own) / max(1, len(own)) for c in (0, 1)]
            assert abs(a[k] - want[0]) < 1e-9 and abs(b[k] - want[1]) < 1e-9


def test_pooled_model_is_a_distribution():
    toxic, ordinary = count(TOXIC), count(ORDINARY)
    log = plain(toxic, ordinary, 0.4)
    for context in {g[:-1] for g in log}:
        own = [0.4 * math.exp(a) + 0.6 * math.exp(b) for g, (a, b) in log.items() if g[:-1] == context and len(g) == len(context) + 1]
        assert 0 < sum(own) <= 1 + 1e-9


def test_repeated_ids_and_labels(spark):
    """An id with several texts and labels: the same model however the rows lie, and one row of it in training."""
    docs = [(i, f"word{i % 7} zzgrim zzgrot" if i % 3 == 0 else f"word{i % 7} calm river") for i in range(60)] + [(3, "calm river"), (3, "calm river"), (1, "zzgrim")] * 30
    labels = [(i, int(i % 3 == 0)) for i in range(60)] + [(4, 1), (5, None)]
    models = []
    for n in (1, 5):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        models.append(tox.train(d, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(n)))
    a, b = models
    assert np.allclose(a.toxic, b.toxic) and np.allclose(a.ordinary, b.ordinary) and abs(a.slope - b.slope) < 1e-9


def test_cluster_fit_equals_plain_kneser_ney(spark):
    """Every order made on the cluster against plain dictionaries; without likelihoods the evidence is the same."""
    texts = [(t, 1, i % tox.FOLDS) for i, t in enumerate(TOXIC * 9)] + [(t, 0, i % tox.FOLDS) for i, t in enumerate(ORDINARY * 9)]
    rows = spark.createDataFrame(texts, "text string, toxic int, fold int")
    whole, small = tox.fit(rows, 0.3), tox.fit(rows, 0.3, likelihoods=False)
    toxic, ordinary = count(TOXIC * 9), count(ORDINARY * 9)
    log = plain(toxic, ordinary, len(TOXIC) / (len(TOXIC) + len(ORDINARY)))
    known = whole.grams.get(np.array([number(g) | len(g) << 48 for g in log], np.uint64))
    assert len(whole.toxic) == len(log) + 1 and (known > 0).all()
    assert np.allclose(whole.toxic[known], [a for a, _ in log.values()]) and np.allclose(whole.ordinary[known], [b for _, b in log.values()])
    assert len(small.toxic) < len(whole.toxic)
    column = pa.array(TOXIC + ORDINARY + ["something not seen at all: zzgrim QXJ"])
    (_, a), (_, b) = *whole.evidence(column), *small.evidence(column)
    assert np.allclose(a, b) and abs(a).max() > 0.1 and abs(whole.slope - small.slope) < 1e-9
    # the curve from means against the curve from single rows
    own = [(t, y, f) for t, y, f in texts]
    seen = []
    for t, y, f in own:
        left = [x for x in own if x[2] != f]
        c = [count([u for u, z, _ in left if z == want]) for want in (1, 0)]
        grams_ = sorted(set(c[0]) | set(c[1]))
        share = sum(z for _, z, _ in left) / len(left)
        model = tox.Model(np.array([number(g) | len(g) << 48 for g in grams_], np.uint64), np.array([c[0][g] for g in grams_]), np.array([c[1][g] for g in grams_]), share)
        seen.append(next(e for _, e in model.evidence(pa.array([t])))[0])
    seen = np.array(seen)
    exact = tox.Model.of(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0)
    exact.calibrate(seen, np.array([y for _, y, _ in own]), np.ones(len(own)), float(seen.std()), 0.3)
    assert abs(exact.slope - whole.slope) < 1e-3 * abs(exact.slope) and abs(exact.bias - whole.bias) < 1e-3 * max(1, abs(exact.bias))


def test_all_labelled_rows_are_used(spark):
    texts = [f"{i:05d}" for i in range(4500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = tox.train(rows, spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(4500)], "doc_id long, toxic int"))
    held = {r.doc_id for r in rows.where(tox.held_out()).collect()}
    assert len(held) < 1200 and all((model.grams.get(np.array([number(t.encode()) | tox.ORDER << 48], np.uint64)) > 0).all() for i, t in enumerate(texts) if i not in held)
