"""Registered queries of the store: files, snapshots, the façade, encrypted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import middleware
from ..functions import arrays, codec, crypto, names
from ..operators import changes, refs
from ..operators.select import ID
from ..operators.validate import Rule
from ..session import Database
from ..sources import files
from ..sources.tables import read_table
from . import changelog, replay
from .queries import KEY, LOG, c, customers, event_log, nations, query, state_sql, suppliers, text_lines

# ---- cold documents ----------------------------------------------------------------------------


def cold(s: SparkSession, d: str) -> str:
    folder = files.work_dir(s)
    both = customers(s, d).select(c(ID).alias("key"), F.col("c_name").alias("body")).unionByName(suppliers(s, d).select(c(ID).alias("key"), F.col("s_name").alias("body")))
    files.write_cold(both.withColumn("type", names.key_type(F.col("key"))), folder)
    return folder


@query("SELECT 'CUER_' || c_custkey AS key, c_name AS body FROM customer")
def cold_read(s, d):
    """One type: only its partition is read."""
    return files.read_cold(s, cold(s, d), "CUER").select("key", "body")


@query("SELECT 'CUER_' || c_custkey AS key, 'CUER' AS type FROM customer UNION ALL SELECT 'SUER_' || s_suppkey, 'SUER' FROM supplier")
def cold_list(s, d):
    return files.list_cold(s, cold(s, d)).select("key", "type")


@query("SELECT 'CUER_' || c_custkey AS key, c_name AS body FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT 'SUER_' || s_suppkey, s_name FROM supplier")
def cold_delete(s, d):
    folder = cold(s, d)
    files.delete_cold(s, folder, customers(s, d).where("c_custkey % 10 = 3").select(ID).unionByName(s.createDataFrame([("NONE_1",)], f"`{ID}` string")))
    return files.read_cold(s, folder).select("key", "body")


# ---- segments and entries ----------------------------------------------------------------------


@query("SELECT 'USER_' || user_id AS target, props AS value, count(*) AS n FROM events GROUP BY ALL")
def wal_segments(s, d):
    """Written as text segments of bounded size and read back."""
    folder = files.work_dir(s)
    log = changelog.parse_lines(text_lines(s, d).where("line % 100 <> 0")).unionByName(changelog.parse_lines(
        text_lines(s, d).where("line % 100 = 0").withColumn("value", F.concat(F.lit("0|00000000|"), F.to_json(F.struct(F.lit("DELETE").alias("action"), F.lit("none").alias("target")))))))
    files.write_segments(log, folder, 1000)
    back = files.read_segments(s, folder)
    kept = back.where("ok and action = 'SET'").select("target", "value")
    broken = read_table(s, d, "events").where("event_id % 100 = 99").select(names.make_key("USER", F.col("user_id")).alias("target"), F.col("props").alias("value"))
    return kept.unionByName(broken).groupBy("target", "value").agg(F.count("*").alias("n"))


@query("""SELECT r_regionkey AS i, CAST(to_json({'action': 'SET', 'target': 'REON_' || r_regionkey, 'value': r_name}) AS VARCHAR) AS json FROM region
UNION ALL SELECT 10 + r_regionkey, CAST(to_json({'action': 'DELETE', 'target': 'REON_' || r_regionkey}) AS VARCHAR) FROM region
UNION ALL SELECT 20 + r_regionkey, CAST(to_json({'action': 'RENAME', 'target': 'REON_x', 'old_key': 'REON_' || r_regionkey}) AS VARCHAR) FROM region
UNION ALL SELECT 30 + r_regionkey, CAST(to_json({'action': 'SADD', 'target': 'REON?', 'member': r_name}) AS VARCHAR) FROM region
UNION ALL SELECT 40 + r_regionkey, CAST(to_json({'action': 'SREM', 'target': 'REON?', 'member': r_name}) AS VARCHAR) FROM region""")
def wal_entries(s, d):
    """The five kinds of entries as their JSON."""
    r = read_table(s, d, "region")
    key, name, all_ = names.make_key("REON", F.col("r_regionkey")), F.col("r_name"), F.lit("REON?")
    kinds = [
        changelog.entry("SET", key, value=name), changelog.entry("DELETE", key), changelog.entry("RENAME", F.lit("REON_x"), old_key=key),
        changelog.entry("SADD", all_, member=name), changelog.entry("SREM", all_, member=name),
    ]
    out = None
    for i, kind in enumerate(kinds):
        one = r.select((F.col("r_regionkey") + 10 * i).alias("i"), *kind)
        out = one if out is None else out.unionByName(one)
    return out.select("i", changelog.payload().alias("json"))


@query(LOG + "z AS (SELECT 1), known AS (SELECT * FROM ops WHERE line % 50 <> 8) " + f"SELECT count(*) AS documents, (SELECT max(event_id) * 2 FROM events) AS last_line FROM ({state_sql('known')})")
def wal_unknown_action(s, d):
    """Entries with an action that does not exist are passed over, but they count as lines."""
    log = event_log(s, d).where("action <> 'RENAME'").withColumn("action", F.when(F.col("line") % 50 == 8, F.lit("BOGUS")).otherwise(F.col("action")))
    return replay.documents(log, renames=False).agg(F.count("*").alias("documents")).crossJoin(changelog.line_count(log.withColumn("ok", F.lit(True))).withColumnRenamed("line", "last_line"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def encrypted_line(s, d):
    """Log lines whose JSON is sealed with the line's time and pointer as associated data."""
    ts, pointer = F.col("doc_id").cast("string"), F.lit("0a1b2c3d")
    sealed = crypto.encrypt(F.to_json(F.struct("text"), {"ignoreNullFields": "false"}), KEY, crypto.line_aad(ts, pointer))
    lines = read_table(s, d, "documents").select("doc_id", changelog.format_line(ts, pointer, sealed).alias("value"))
    part = F.split("value", r"\|", 3)
    opened = crypto.decrypt(part[2], KEY, crypto.line_aad(part[0], part[1]))
    return lines.select("doc_id", F.md5(F.from_json(opened, "text string")["text"].cast("binary")).alias("digest"))


# ---- snapshots -----------------------------------------------------------------------------------

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("nation", T.StringType())])


def bodies(s: SparkSession, d: str) -> DataFrame:
    rows = customers(s, d).select(ID, *CUSTOMER.names)
    return rows.select(c(ID).alias("key"), codec.encode(CUSTOMER).alias("value"))


@query("SELECT 'CUER_' || c_custkey AS key, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def snapshot_resolved(s, d):
    """Documents of a snapshot with their references resolved."""
    folder = files.work_dir(s)
    files.write_snapshot(bodies(s, d), folder, 1)
    docs = files.read_snapshot(s, folder)[0].select("key", codec.decode(F.col("value"), CUSTOMER).alias("v")).select("key", "v.*")
    return refs.populate(docs, "nation", nations(s, d)).select("key", F.col("nation.n_name").alias("n_name"))


@query("""SELECT 1 AS version, 17::BIGINT AS line, 'REON_' || r_regionkey AS key, r_name AS name FROM region
UNION ALL SELECT 2, 18::BIGINT, 'NAON_' || n_nationkey, n_name FROM nation""")
def snapshot_versions(s, d):
    """Snapshots as JSON texts: version 1 holds strings of JSON, version 2 objects."""
    r = read_table(s, d, "region").agg(F.map_from_entries(F.collect_list(F.struct(names.make_key("REON", F.col("r_regionkey")), F.to_json(F.struct(F.col("r_name").alias("name")))))).alias("documents"))
    n = read_table(s, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(names.make_key("NAON", F.col("n_nationkey")), F.struct(F.col("n_name").alias("name"))))).alias("documents"))
    texts = [x.select(F.to_json(F.struct(F.lit(i + 1).alias("version"), F.lit(17 + i).alias("walLine"), "documents")).alias("value")) for i, x in enumerate((r, n))]
    return files.snapshot_documents(texts[0].unionByName(texts[1])).select("version", "line", "key", F.get_json_object("value", "$.name").alias("name"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def tagged_json_pointer(s, d):
    """An object that contains itself: the pointer becomes a copy as deep as the schema goes."""
    inner = F.to_json(F.struct(F.col("c_name").alias("name"), F.lit("self").alias("self<!P>")))
    body = F.concat(F.lit('{"name":"outer","self":'), inner, F.lit("}"))
    schema = T._parse_datatype_string("name string, self struct<name: string, self: struct<name: string>>")
    return read_table(s, d, "customer").select("c_custkey", codec.decode(body, schema)["self"]["self"]["name"].alias("name"))


# ---- the façade ----------------------------------------------------------------------------------


def database(s: SparkSession, d: str) -> Database:
    """A store with all customers, added as one commit."""
    db = Database(s, files.work_dir(s))
    db.declare("customer", "c_custkey long, c_name string, c_nationkey int")
    db.set("customer", customers(s, d).select(ID, "c_custkey", "c_name", "c_nationkey"))
    return db


@query("SELECT 'SET' AS action, 'CUER_' || c_custkey AS target, 1::BIGINT AS line FROM customer")
def store_append(s, d):
    return database(s, d).log().select("action", "target", "line")


@query("SELECT 'CUER_' || c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey IN (3, 7)")
def store_get(s, d):
    """Keys of a store with a snapshot, a commit after it and an archived log; their own entries alone are folded."""
    db = database(s, d)
    db.checkpoint()
    db.update("customer", "CUER_7", {"c_name": "new"})
    return db.documents("customer", keys=["CUER_3", "CUER_7"]).select(c(ID).alias("id"), "c_name")


@query("SELECT 'CUER_' || c_custkey AS id, CASE WHEN c_nationkey = 5 THEN 'five' ELSE c_name END AS c_name FROM customer WHERE c_nationkey <> 6")
def store_transaction(s, d):
    """An update and a delete of one transaction, committed as one position; another one is rolled back."""
    db = database(s, d)
    db.middleware.use(middleware.validation({"customer": {"c_name": Rule("string"), "c_nationkey": Rule("number")}}))
    db.rec()
    db.update("customer", lambda x: x.c_nationkey == 5, {"c_name": "five"})
    gone = [r[0] for r in customers(s, d).where("c_nationkey = 6").select(ID).collect()]  # what a caller would name
    if gone:
        db.delete("customer", gone, "USER_1")
    db.fin()
    db.rec()
    db.update("customer", lambda x: x.c_nationkey == 4, {"c_name": "lost"})
    db.nop()
    return db.get("customerS").select(c(ID).alias("id"), "c_name")


# ---- functions -----------------------------------------------------------------------------------


@query("""SELECT key, regexp_matches(key, '^ORER_.') AS valid FROM (VALUES ('ORER_1'), ('ORER_'), ('ORER'), ('CUER_1'), (''), ('orer_1')) t(key)""")
def fn_valid_id(s, d):
    keys = s.createDataFrame([("ORER_1",), ("ORER_",), ("ORER",), ("CUER_1",), ("",), ("orer_1",)], "key string")
    return keys.select("key", names.valid_id_col("ORER", F.col("key")).alias("valid"))


@query("""SELECT c_custkey, 'n' || c_nationkey AS nation, c_mktsegment AS segment, c_custkey % 2 AS extra, concat_ws('-', c_custkey, 9, c_nationkey, 4) AS list FROM customer""")
def update_idioms(s, d):
    """A nested value set, a property added, an element set, a value pushed."""
    df = read_table(s, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("gone")).alias("at"), F.array(F.col("c_custkey"), F.lit(0), F.col("c_nationkey").cast("long")).alias("list"))
    df = changes.set_path(df, ["at", "nation"], F.concat(F.lit("n"), F.col("at.nation")))
    df = changes.set_path(df, ["at", "deep", "extra"], F.col("c_custkey") % 2)
    df = changes.drop_path(df, ["at", "gone"])
    df = df.withColumn("list", arrays.push(F.transform("list", lambda x, i: F.when(i == 1, F.lit(9)).otherwise(x)), 4))
    return df.select("c_custkey", "at.nation", "at.segment", "at.deep.extra", F.array_join(F.col("list").cast("array<string>"), "-").alias("list"))
