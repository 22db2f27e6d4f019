import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafledger.errors import CryptoError, InvalidSelector
from leafledger.functions import arrays, codec, crypto, names, paths
from leafledger.operators import changes, refs, select, stats
from leafledger.operators.validate import Rule, validate
from leafledger.plans import changelog, replay, txn
from leafledger.sources import files

ID = "$ID"


def one(df, *cols):
    return tuple(df.select(*cols).first())


def test_names():
    assert [names.short_code(n) for n in ("user", "userS", "account", "order", "a")] == ["USER", "USER", "ACNT", "ORER", "AA"]
    assert names.check_name("item123") == "item123" and names.check_name("userS") == "user"


def test_derived_ids(spark):
    ids = [r[0] for r in spark.range(5000).select(names.derived_id(F.col("id"))).collect()]
    assert len(set(ids)) == 5000 and all(len(i) == 7 and set(i) <= set(names.ALPHABET) for i in ids)


def test_match_truth_table(spark):
    df = spark.createDataFrame([(1, 2, ("special", 3), ["a", "b"], None)], "a int, b int, data struct<type:string,count:int>, tags array<string>, n string")
    yes = lambda q, deep=False: select.where(df, q, deep).count() == 1
    assert yes({"a": 1}) and not yes({"a": 2}) and not yes({"c": 1}) and yes({}) and yes({"data": {"type": "special"}}) and not yes({"data": {"type": "x"}})
    assert yes({"tags": ["a"]}) and yes({"tags": ["a", "b"]}) and not yes({"tags": ["b"]}) and not yes({"tags": ["a"]}, True) and yes({"tags": ["a", "b"]}, True)
    assert yes({"n": None}) and not yes({"n": "x"}) and not yes({"a": {"x": 1}}) and yes({"tags": []}) and not yes({"tags": []}, True) and not yes({"tags": ["a", "b", "c"]})
    with pytest.raises(InvalidSelector):
        select.where(df, 5)


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "v array<string>")
    v = F.col("v")
    assert one(df, arrays.splice(v, 1, 1), arrays.push(v, "d"), arrays.pop(v), arrays.shift(v), arrays.set_at(v, 0, "z"), arrays.remove_at(v, 2)) == (["a", "c"], ["a", "b", "c", "d"], ["a", "b"], ["b", "c"], ["z", "b", "c"], ["a", "b"])
    assert one(df, arrays.find(v, lambda x: x > "a"), arrays.find_index(v, lambda x: x == "c"), arrays.find_index(v, lambda x: x == "q"), arrays.index_of(v, "b")) == ("b", 2, -1, 1)
    assert one(df, arrays.reduce_right(v, F.lit(""), lambda a, x: F.concat(a, x)), arrays.flat_map(v, lambda x: F.array(x, x))) == ("cba", ["a", "a", "b", "b", "c", "c"])


def test_flatten_nested_and_set_drop(spark):
    df = spark.createDataFrame([("K", (("x", None),), ["p", "q"])], f"`{ID}` string, a struct<b:struct<c:string,d:string>>, l array<string>")
    got = {tuple(r.path): r.value for r in paths.flatten_paths(df, ID).collect()}
    assert got == {("a", "b", "c"): "x", ("l", "0"): "p", ("l", "1"): "q"}
    deep = changes.set_path(df, ["a", "b", "d"], F.lit("new"))
    assert deep.first().a.b.asDict() == {"c": "x", "d": "new"}
    fresh = changes.set_path(df, ["n", "m", "o"], F.lit(1))
    assert fresh.first().n.m.o == 1 and fresh.first().a.b.c == "x"
    assert changes.drop_path(df, ["a", "b", "c"]).first().a.b.asDict() == {"d": None}


def test_codec_round_trip(spark):
    schema = T.StructType([
        T.StructField("when", T.TimestampType()), T.StructField("days", T.ArrayType(T.TimestampType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())),
        T.StructField("e", codec.ERROR), T.StructField("in", T.StructType([T.StructField("at", T.TimestampType()), T.StructField("s", T.StringType())])),
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField("at", T.TimestampType())]))), T.StructField("no", T.StringType()),
    ])
    t = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(t, [t, None], {"a": 1}, ("TypeError", "bad", "s"), (t, "é\"<"), [(t,)], None)], schema)
    body = df.select(codec.encode(schema).alias("b"))
    text = body.first().b
    assert '"when<!D>":1704164645678' in text and '"days<![D]>"' in text and '"e<!E>":["TypeError","bad","s"]' in text and '"m<!M>"' in text and '"no"' not in text
    assert body.select(codec.decode(F.col("b"), schema).alias("r")).first().r == df.first()


def test_crypto(spark, tmp_path, monkeypatch):
    key = bytes(range(32))
    df = spark.createDataFrame([("",), ("é" * 5000,), ('{"a":1}',)], "t string")
    sealed = df.select("t", crypto.encrypt(F.col("t"), key, F.lit("ctx")).alias("s"))
    assert all(r[0] == r[1] for r in sealed.select("t", crypto.decrypt(F.col("s"), key, F.lit("ctx"))).collect())
    for bad in ((bytes(32), "ctx"), (key, "other")):
        with pytest.raises(Exception, match="AES"):
            sealed.select(crypto.decrypt(F.col("s"), bad[0], F.lit(bad[1]))).collect()
    with pytest.raises(CryptoError):
        crypto.encrypt(F.col("t"), b"short")
    monkeypatch.setenv("SOME_KEY", key.hex())
    assert crypto.key_from_env("SOME_KEY") == key
    path = tmp_path / "k"
    path.write_text(key.hex())
    path.chmod(0o644)
    with pytest.raises(CryptoError):
        crypto.key_from_file(str(path))
    path.chmod(0o600)
    assert crypto.key_from_file(str(path)) == key
    calls = []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return key.hex()

    assert crypto.key_from(fetch) == key and len(calls) == 3


def test_validation(spark):
    df = spark.createDataFrame([("A", 1, "active", ("x", 5), [1, 2]), (None, 1, "active", ("x", 5), [1]), ("A", 1, "gone", ("x", 5), [1]), ("A", 1, "active", (None, 5), [1]), ("A", 1, "active", ("x", 5), [1, None])], "name string, age int, state string, profile struct<name:string,age:int>, numbers array<int>")
    rules = {"name": Rule("string"), "age": Rule("number"), "state": Rule("string", enum=["active"]), "profile": Rule("object", properties={"name": Rule("string")}), "numbers": Rule("array", items=Rule("number"))}
    assert [r.error for r in validate(df, rules).collect()] == [None, "name is required", "state must be one of active", "profile.name is required", "numbers[] is required"]
    assert validate(df, {"age": Rule("string")}).first().error == "age must be of type string"
    assert validate(df, {"zip": Rule("string")}).first().error == "zip is required"


LOG = "line long, action string, target string, old_key string, member string, value string"


def random_log(seed, n=120):
    rng = random.Random(seed)
    keys = [f"K_{i}" for i in range(8)]
    out = []
    for line in range(1, n + 1):
        a = rng.choice(["SET", "SET", "DELETE", "RENAME", "SADD", "SREM", "WHAT"])
        k = rng.choice(keys)
        row = [line, a, k, None, None, None]
        if a == "SET":
            row[5] = f"v{line}"
        elif a == "RENAME":
            row[3] = rng.choice([x for x in keys if x != k])
        elif a in ("SADD", "SREM"):
            row[2], row[4] = "S?", k
        out.append(tuple(row))
    return out


def fold(rows):
    docs, sets = {}, set()
    for _, a, t, old, m, v in rows:
        if a == "SET":
            docs[t] = v
        elif a == "DELETE":
            docs.pop(t, None)
        elif a == "RENAME" and old in docs:
            docs[t] = docs.pop(old)
        elif a == "SADD":
            sets.add((t, m))
        elif a == "SREM":
            sets.discard((t, m))
    return docs, sets


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_sequential_fold_at_any_cut(spark, seed, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = random_log(seed, 30)
    docs, sets = fold(rows)
    log = spark.createDataFrame(rows, LOG)
    assert {r.key: r.value for r in replay.documents(log).collect()} == docs
    assert {tuple(r) for r in replay.sets(log).collect()} == sets
    cut = 17
    snap = replay.as_of(log, cut)
    assert {r.key: r.value for r in snap.collect()} == fold(rows[:cut])[0]
    assert {r.key: r.value for r in replay.from_snapshot(snap, cut, log).collect()} == docs


def test_squash_and_pop(spark):
    base = spark.createDataFrame([("K_1", "a"), ("K_2", "b"), ("OLD_1", "o")], "key string, value string")
    acts = spark.createDataFrame([(1, "SET", "K_1", None, None, "x"), (2, "SET", "K_1", None, None, "y"), (3, "DELETE", "K_2", None, None, None), (4, "RENAME", "NEW_1", "OLD_1", None, None), (5, "SADD", "S?", None, "m", None), (6, "SREM", "S?", None, "m", None)], LOG)
    got = {(r.action, r.target, r.member, r.value) for r in txn.squash(acts, base).collect()}
    assert got == {("SET", "K_1", None, "y"), ("DELETE", "K_2", None, None), ("DELETE", "OLD_1", None, None), ("SET", "NEW_1", None, "o"), ("SREM", "S?", "m", None)}
    assert {r.key: r.value for r in txn.overlay(base, acts).collect()} == {"K_1": "y", "NEW_1": "o"}
    assert {r.key: r.value for r in txn.overlay(base, txn.pop(acts, 3)).collect()} == {"K_1": "y", "OLD_1": "o"}
    assert txn.pop(acts.limit(0)).count() == 0


def test_patch_applies(spark):
    a = spark.createDataFrame([("K", "x", 1), ("L", "y", 2)], f"`{ID}` string, s string, n int")
    b = spark.createDataFrame([("K", "z", None), ("M", "w", 3)], f"`{ID}` string, s string, n int")
    p = changes.patch(a, b)
    assert {tuple(r) for r in p.collect()} == {("K", "replace", "/s", "z"), ("K", "remove", "/n", None), ("L", "remove", "/s", None), ("L", "remove", "/n", None), ("M", "add", "/s", "w"), ("M", "add", "/n", "3")}


def test_chain_verify_segments(spark, tmp_path):
    rows = [(i // 5, i, f"j{i}") for i in range(20)]
    log = spark.createDataFrame(rows, "seg int, line long, json string")
    chain = changelog.build_chain(log, ["seg"])
    assert changelog.verify(chain, ["seg"]).count() == 0
    bad = chain.withColumn("pointer", F.when(F.col("line") == 7, F.lit("BADPTR00")).otherwise(F.col("pointer")))
    assert sorted(r.line for r in changelog.verify(bad, ["seg"]).collect()) == [7, 8]
    whole = changelog.build_chain(log.withColumn("seg", F.lit(0)), ["seg"]).drop("seg").join(log.select("line", "seg"), "line")
    assert changelog.verify(whole, ["seg"], chained_segments=True).count() == 0
    lines = whole.select("line", F.lit("t").alias("ts"), "pointer", F.to_json(F.struct(F.lit("SET").alias("action"), F.col("json").alias("target"))).alias("json"))
    files.write_segments(lines, str(tmp_path / "wal"), 6)
    back = files.read_segments(spark, str(tmp_path / "wal"))
    assert back.where("ok").count() == 20 and {r.target for r in back.collect()} == {f"j{i}" for i in range(20)}


def test_cold_and_snapshot_files(spark, tmp_path):
    docs = spark.createDataFrame([("USER_1", "{}", "USER"), ("ITEM_1", "{}", "ITEM")], "key string, body string, type string")
    files.write_cold(docs, str(tmp_path / "cold"))
    assert files.read_cold(spark, str(tmp_path / "cold"), "USER").count() == 1 and files.list_cold(spark, str(tmp_path / "cold")).count() == 2
    assert files.read_snapshot(spark, str(tmp_path / "s")) is None
    for n in (1, 2):
        files.write_snapshot(docs.select("key", F.lit(str(n)).alias("value")), str(tmp_path / "s"), n)
    state, line = files.read_snapshot(spark, str(tmp_path / "s"))
    assert line == 2 and {r.value for r in state.collect()} == {"2"}


def test_populate_keeps_order_repetitions_and_gaps(spark):
    book = spark.createDataFrame([("B_1", ["T_2", "T_9", "T_1", "T_2"]), ("B_2", []), ("B_3", None)], f"`{ID}` string, tagz array<string>")
    tag = spark.createDataFrame([("T_1", "one"), ("T_2", "two")], f"`{ID}` string, name string")
    got = {r[ID]: r.tagz for r in refs.populate_array(book, "tagz", tag).collect()}
    assert [t and t.name for t in got["B_1"]] == ["two", None, "one", "two"] and got["B_2"] == [] and got["B_3"] is None
    with pytest.raises(KeyError):
        refs.populate(book, "none", tag)
    assert one(book.agg(stats.mean_null_as_zero(F.size("tagz"))), "*")[0] == pytest.approx(1.0, abs=0.5)
