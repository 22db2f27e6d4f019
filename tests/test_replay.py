import random

import pytest

from leafledger.plans import replay, txn
from leafledger.sources import files

SCHEMA = "line long, action string, target string, old_key string, member string, value string"


def fold(entries):
    """The log, entry by entry."""
    state = {}
    for line, action, target, old, _, value in sorted(entries):
        if action == "SET":
            state[target] = value
        elif action == "DELETE":
            state.pop(target, None)
        elif action == "RENAME" and old in state and old != target:
            state[target] = state.pop(old)
    return state


def check(spark, entries):
    got = replay.documents(spark.createDataFrame(entries, SCHEMA).repartition(3)).collect()
    assert {r.key: r.value for r in got} == fold(entries) and len(got) == len(fold(entries))


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rng, entries = random.Random(seed), []
    keys = [f"K_{i}" for i in range(7)]
    for line in range(1, 160):
        kind = rng.choices(("SET", "DELETE", "RENAME", "ODD"), (3, 2, 6, 1))[0]
        entries.append((line, kind, rng.choice(keys), rng.choice(keys) if kind == "RENAME" else None, None, f"v{line}" if kind == "SET" else None))
    check(spark, entries)


def test_chain_of_fifty_with_an_empty_link(spark):
    entries = [(1, "SET", "K_0", None, None, "first"), (2, "SET", "N_9", None, None, "other")]
    entries += [(10 + i, "RENAME", f"K_{i + 1}", f"K_{i}", None, None) for i in range(50)]
    entries += [(100, "RENAME", "N_9", "N_8", None, None), (101, "RENAME", "N_10", "N_9", None, None), (102, "RENAME", "K_50", "K_50", None, None)]
    check(spark, entries)
    assert fold(entries) == {"K_50": "first", "N_10": "other"}


def test_work_does_not_grow_with_the_length_of_chains(spark, monkeypatch):
    written, kept = [], files.kept

    def counted(s, df, *folder):
        written.append(df.count())
        return kept(s, df, *folder)

    monkeypatch.setattr(files, "kept", counted)
    monkeypatch.setattr(replay, "DOUBLED", 150, raising=False)
    n = 2000
    entries = [(0, "SET", "K_0", None, None, "first")] + [(i, "RENAME", f"K_{i}", f"K_{i - 1}", None, None) for i in range(1, n + 1)]
    check(spark, entries)
    assert sum(written) < 8 * n, [round(x / n, 2) for x in written]


def test_ends_of_paths(spark, monkeypatch):
    monkeypatch.setattr(replay, "DOUBLED", 40)
    rng = random.Random(5)
    to = {i: rng.randrange(max(0, i - 4), i) for i in range(1, 400) if i % 90}  # trees whose roots are 0, 90, 180 ...
    got = replay._ends(spark.createDataFrame(list(to.items()), "id long, to long"), spark).collect()

    def end(i):
        return end(to[i]) if i in to else i

    assert len(got) == len(to) and {r.id: r.to for r in got} == {i: end(i) for i in to}


def test_long_paths_with_empty_links(spark, monkeypatch):
    monkeypatch.setattr(replay, "DOUBLED", 10)
    entries = [(1, "SET", "K_0", None, None, "first"), (2, "SET", "K_20", None, None, "other"), (3, "SET", "L_3", None, None, "third")]
    entries += [(10 + i, "RENAME", f"K_{i + 1}", f"K_{i}", None, None) for i in range(45)]
    entries += [(11 + i, "RENAME", f"L_{i + 1}", f"L_{i}", None, None) for i in range(45)]  # nothing to move before L_3
    check(spark, entries)


def test_keys_that_only_renames_touched_are_deleted_in_a_transaction(spark):
    actions = spark.createDataFrame([(0, "SET", "A_1", None, None, "a")] + [(i, "RENAME", f"A_{i + 1}", f"A_{i}", None, None) for i in range(1, 4)], SCHEMA)
    base = spark.createDataFrame([("B_1", "b")], "key string, value string")
    got = {(r.action, r.target, r.value) for r in txn.squash(actions, base).collect()}
    assert got == {("DELETE", f"A_{i}", None) for i in (1, 2, 3)} | {("SET", "A_4", "a")}
