"""Beliefs against exact inference, and license matches against full alignment."""

import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest

from leafledger.llm import licenses, pii


def exact(field, t):
    """Marginals by summing over all labellings."""
    n, m = len(t.spans), field.node.shape[1]
    p = np.zeros((n, m))
    for labels in itertools.product(range(m), repeat=n):
        if any(c and labels[i] != c for i, c in enumerate(t.clamp)):
            continue
        s = sum(field.node[t.features[i]].sum(0)[labels[i]] for i in range(n) if not t.clamp[i])
        s += sum(field.chain[labels[a], labels[b]] for a, b in t.chain) + sum(field.skip[labels[a], labels[b]] for a, b in t.skip + t.ties)
        for i in range(n):
            p[i, labels[i]] += np.exp(s)
    return p / p.sum(1, keepdims=True)


def graph(rng, n, chain, skip, ties=()):
    clamp = [rng.randrange(1, 5) if rng.random() < 0.3 else 0 for _ in range(n)]
    return SimpleNamespace(spans=[(i, i + 1) for i in range(n)], features=[[0, 1 + rng.randrange(6), 13 + rng.randrange(6)] for _ in range(n)], clamp=clamp, chain=list(chain), skip=list(skip), ties=list(ties))


def field(seed, strength=1.0):
    r = np.random.default_rng(seed)
    sym = lambda a: (a + a.T) / 2 * strength
    return pii.Field(r.normal(size=(24, 5)), sym(r.normal(size=(5, 5))), sym(r.normal(size=(5, 5))))


@pytest.mark.parametrize("seed", range(6))
def test_beliefs_are_exact_on_trees(monkeypatch, seed):
    monkeypatch.setattr(pii, "ROUNDS", 80)
    rng = random.Random(seed)
    for chain, skip, ties in (([(0, 1), (1, 2), (2, 3)], [], []), ([(0, 1), (2, 3)], [(1, 3)], [(0, 4)]), ([], [(0, 2), (1, 2), (2, 4)], [(2, 3)])):
        t, f = graph(rng, 5, chain, skip, ties), field(seed)
        assert np.allclose(f.beliefs(t), exact(f, t), atol=1e-6)


def test_beliefs_are_near_on_loops(monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 80)
    rng, off, same = random.Random(1), [], []
    for seed in range(20):
        t, f = graph(rng, 5, [(0, 1), (1, 2), (2, 3), (3, 4)], [(0, 3), (1, 4)], [(0, 4)]), field(seed, 0.7)
        a, b = f.beliefs(t), exact(f, t)
        off.append(abs(a - b).max())
        same.append((a.argmax(1) == b.argmax(1)).mean())
    assert np.mean(off) < 0.1 and np.mean(same) > 0.95


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(8))
def test_licenses_against_full_alignment(seed):
    rng, index = random.Random(seed), licenses.Index(licenses.TEMPLATES)
    for name in [n for n in index.names if len(index.words[index.names.index(n)]) >= 20][:6]:
        words = licenses.TEMPLATES[name].split()
        rate = rng.choice((0.0, 0.05, 0.1, 0.15, 0.3))
        edited = []
        for w in words:
            kind = rng.random() / max(rate, 1e-9)
            edited += [] if kind < 0.3 else [f"odd{rng.randrange(999)}"] if kind < 0.7 else [w, f"odd{rng.randrange(999)}"] if kind < 1 else [w]
        text = [f"lead{i}" for i in range(rng.randrange(60))] + edited + [f"tail{i}" for i in range(30)]
        w = licenses.words_of(*licenses.buffers(licenses.pa.array([" ".join(text)])))
        own = index.words[index.names.index(name)]
        want = common(own, w.hash.tolist())
        got = [n for found, a, b, n, c in index.find(w.hash, 0.8) if found == name]
        if want >= 0.8 * len(own):
            assert got and max(got) == want, (name, rate, want, len(own), got)
        else:
            assert not got, (name, rate)
