"""Registered queries of the engine, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, codec, crypto, names, paths
from ..operators import changes, refs, select, stats
from ..operators.select import ID
from ..operators.validate import Rule, validate
from ..sources import files
from ..sources.tables import from_table, read_table
from ..streaming import subscribe
from . import changelog, replay, txn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUT = "2024-01-25 00:00:00"
KEY = bytes(range(32))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def c(name: str):
    return F.col(f"`{name}`")


def cents(value):
    return F.round(value * 100).cast("long")


def customers(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "customer"), "customer", "c_custkey", {"c_nationkey": ("nation", "nation")})


def orders(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "orders"), "order", "o_orderkey", {"o_custkey": ("customer", "customer")})


def nations(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "nation"), "nation", "n_nationkey", {"n_regionkey": ("region", "region")})


def regions(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "region"), "region", "r_regionkey")


def suppliers(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "supplier"), "supplier", "s_suppkey", {"s_nationkey": ("nation", "nation")})


def parts(s: SparkSession, d: str) -> DataFrame:
    return from_table(read_table(s, d, "part"), "part", "p_partkey")


# ---- lookups ---------------------------------------------------------------------------------

CENTS = "CAST(round({0} * 100) AS BIGINT)"
OPRICE = CENTS.format("o_totalprice")


@query(f"""SELECT 'ORER_' || o_orderkey AS id, {OPRICE} AS total, c_name AS customer, n_name AS nation, r_name AS region
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def populate_deep(s, d):
    """Urgent open orders with customer, nation and region inside each other."""
    nation = refs.populate(nations(s, d), "region", regions(s, d))
    customer = refs.populate(customers(s, d), "nation", nation)
    urgent = select.where(orders(s, d), lambda o: (o.o_orderstatus == "O") & (o.o_orderpriority == "1-URGENT"))
    full = refs.populate(urgent, "customer", customer)
    return full.select(c(ID).alias("id"), cents(c("o_totalprice")).alias("total"), F.col("customer.c_name").alias("customer"), F.col("customer.nation.n_name").alias("nation"), F.col("customer.nation.region.r_name").alias("region"))


@query("SELECT 'CUER_' || c_custkey AS id, c_name FROM customer")
def scan_collection(s, d):
    return customers(s, d).select(c(ID).alias("id"), "c_name")


@query("SELECT count(*) AS n FROM customer")
def count_collection(s, d):
    return customers(s, d).agg(F.count("*").alias("n"))


@query("SELECT 'CUER_' || c_custkey AS id, c_mktsegment FROM customer")
def project_fields(s, d):
    return customers(s, d).select(c(ID).alias("id"), "c_mktsegment")


@query(f"SELECT 'ORER_' || o_orderkey AS id, {OPRICE} AS total FROM orders WHERE o_orderkey = 7")
def get_by_id(s, d):
    return select.get_by_id(orders(s, d), "ORER", "ORER_7").select(c(ID).alias("id"), cents(c("o_totalprice")).alias("total"))


@query(f"SELECT 'ORER_' || o_orderkey AS id, {OPRICE} AS total FROM orders WHERE o_orderkey = 7")
def get_by_id_object(s, d):
    return select.get_by_id(orders(s, d), "ORER", {ID: "ORER_7", "o_orderkey": 7}).select(c(ID).alias("id"), cents(c("o_totalprice")).alias("total"))


@query("SELECT key, name FROM (SELECT 'CUER_' || c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'SUER_' || s_suppkey, s_name FROM supplier) WHERE key = 'SUER_5'")
def get_any_type(s, d):
    found = select.get_any_type({"CUER": customers(s, d).withColumnRenamed("c_name", "name"), "SUER": suppliers(s, d).withColumnRenamed("s_name", "name")}, "SUER_5")
    return found.select(c(ID).alias("key"), "name")


@query("""SELECT CAST(w.i - 1 AS INTEGER) AS slot, w.k AS wanted, c_name FROM unnest(['CUER_3','CUER_9','CUER_999999999','CUER_3']) WITH ORDINALITY AS w(k, i)
LEFT JOIN customer ON w.k = 'CUER_' || c_custkey""")
def get_by_ids(s, d):
    return select.get_by_ids(customers(s, d), "CUER", ["CUER_3", "9", "CUER_999999999", "CUER_3"]).select("slot", "wanted", "c_name")


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_totalprice > 400000 HAVING count(*) > 0")
def get_first_match(s, d):
    return select.first_match(orders(s, d), lambda o: o.o_totalprice > 400000, [F.col("o_orderkey")]).select("o_orderkey")


# ---- predicates ------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def filter_compare(s, d):
    return select.where(orders(s, d), lambda o: o.o_totalprice > 300000).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'small%'")
def filter_startswith(s, d):
    return select.where(parts(s, d), lambda p: p.p_name.startswith("small")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 20 AND p_type = 'ECONOMY'")
def filter_and(s, d):
    return select.where(parts(s, d), lambda p: (p.p_size > 20) & (p.p_type == "ECONOMY")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size > 45 OR p_type = 'ECONOMY'")
def filter_or(s, d):
    return select.where(parts(s, d), lambda p: (p.p_size > 45) | (p.p_type == "ECONOMY")).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def filter_in_set(s, d):
    return select.in_set(orders(s, d), "o_custkey", customers(s, d).where("c_acctbal > 9000").select("c_custkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal % 7 > 5 AND length(c_name) > 3")
def filter_function(s, d):
    return select.where(customers(s, d), lambda x: (x.c_acctbal % 7 > 5) & (F.length(x.c_name) > 3)).select("c_custkey")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def filter_nested(s, d):
    return select.where(read_table(s, d, "events"), lambda e: paths.get_json(e.props, ["k"], "long") > 90).select("event_id")


def typed_events(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "events").withColumn("data", F.from_json("props", "k long"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 5 AND event_type = 'view'")
def match_nested(s, d):
    return select.where(typed_events(s, d), {"data": {"k": 5}, "event_type": "view"}).select("event_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def get_by_path(s, d):
    return typed_events(s, d).select("event_id", paths.get_by_path(F.col("data"), ["k"]).alias("k"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def match_partial(s, d):
    return select.where(orders(s, d), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


def priority_lists(s: SparkSession, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    return read_table(s, d, "orders").groupBy("o_custkey").agg(F.transform(rows, lambda x: x["o_orderpriority"]).alias("l"))


LISTS = "WITH p AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) "


@query(LISTS + "SELECT o_custkey FROM p WHERE l[1:2] = ['1-URGENT', '5-LOW']")
def match_array_prefix(s, d):
    return select.where(priority_lists(s, d), {"l": ["1-URGENT", "5-LOW"]}).select("o_custkey")


@query(LISTS + "SELECT o_custkey FROM p WHERE l = ['2-HIGH'] OR l = ['1-URGENT', '5-LOW'] OR l = ['3-MEDIUM', '3-MEDIUM', '1-URGENT']")
def match_deep(s, d):
    p = priority_lists(s, d)
    wanted = (["2-HIGH"], ["1-URGENT", "5-LOW"], ["3-MEDIUM", "3-MEDIUM", "1-URGENT"])
    return p.where(functools.reduce(operator.or_, (select.match(p.schema, {"l": w}, deep=True) for w in wanted))).select("o_custkey")


@query(LISTS + "SELECT o_custkey FROM p WHERE list_contains(l, '1-URGENT')")
def filter_array_contains(s, d):
    return select.where(priority_lists(s, d), lambda x: F.array_contains(x.l, "1-URGENT")).select("o_custkey")


# ---- references ------------------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def populate_single(s, d):
    some = nations(s, d).where("n_regionkey < 3")
    return refs.populate(customers(s, d), "nation", some).select("c_custkey", F.col("nation.n_name").alias("n_name"))


def with_supplier(s: SparkSession, d: str) -> DataFrame:
    return customers(s, d).withColumn("supplier", names.make_key("SUER", F.col("c_custkey") % 110))


MULTI = "SELECT c_custkey, n_name, s_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON c_custkey % 110 = s_suppkey"


@query(MULTI)
def populate_multi(s, d):
    full = refs.populate_all(with_supplier(s, d), {"nation": nations(s, d), "supplier": suppliers(s, d)})
    return full.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("supplier.s_name").alias("s_name"))


@query(MULTI)
def populate_chain(s, d):
    full = refs.populate(refs.populate(with_supplier(s, d), "nation", nations(s, d)), "supplier", suppliers(s, d))
    return full.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.col("supplier.s_name").alias("s_name"))


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def populate_group(s, d):
    return refs.populate(suppliers(s, d), "nation", nations(s, d)).select("s_suppkey", F.col("nation.n_name").alias("n_name"))


@query(f"""SELECT 'CUER_' || o_custkey AS id, string_agg(CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST({OPRICE} AS VARCHAR) END, ',' ORDER BY o_orderkey) AS totals FROM orders GROUP BY o_custkey""")
def populate_array(s, d):
    o = orders(s, d)
    lists = o.groupBy(F.col("customer").alias(ID)).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", ID))), lambda x: x[ID]).alias("orders"))
    full = refs.populate_array(lists, "orders", o.where("o_orderkey % 3 <> 0"), fields=["o_totalprice"])
    text = F.transform("orders", lambda x: F.when(x.isNull(), F.lit("-")).otherwise(cents(x["o_totalprice"]).cast("string")))
    return full.select(c(ID).alias("id"), F.array_join(text, ",").alias("totals"))


@query("SELECT 'ORER_' || o_orderkey AS id, 'CUER_' || o_custkey AS customer FROM orders")
def strip_refs(s, d):
    nested = refs.populate(orders(s, d), "customer", customers(s, d))
    return refs.strip_refs(nested).select(c(ID).alias("id"), "customer")


@query("SELECT 'ORER_' || o_orderkey AS id, c_name, 'NAON_' || c_nationkey AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def resolve_refs(s, d):
    full = refs.populate(orders(s, d), "customer", customers(s, d))
    return full.select(c(ID).alias("id"), F.col("customer.c_name").alias("c_name"), F.col("customer.nation").alias("nation"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def reverse_refs(s, d):
    return refs.children(customers(s, d), "nation", nations(s, d).where("n_regionkey = 1")).select("c_custkey")


@query("""SELECT 'NAON_' || n_nationkey AS id FROM nation WHERE n_regionkey <> 0
UNION ALL SELECT 'CUER_' || c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def cascade_delete(s, d):
    n = nations(s, d)
    a, b = refs.cascade(n, customers(s, d), "nation", n.where("n_regionkey = 0").select(ID))
    return a.select(c(ID).alias("id")).unionByName(b.select(c(ID).alias("id")))


@query("""SELECT r_name, r_regionkey FROM region UNION ALL SELECT DISTINCT c_mktsegment, NULL::INTEGER FROM customer WHERE c_mktsegment NOT IN (SELECT r_name FROM region)""")
def find_or_create(s, d):
    wanted = read_table(s, d, "customer").select(F.col("c_mktsegment").alias("r_name"))
    return changes.find_or_create(read_table(s, d, "region"), wanted, ["r_name"], lambda x: x.select("r_name")).select("r_name", "r_regionkey")


# ---- aggregates, order, pages ----------------------------------------------------------------


@query(f"SELECT o_custkey, CAST(floor(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE {OPRICE} END) / count(*)) AS BIGINT) AS mean FROM orders GROUP BY o_custkey")
def agg_avg_null_as_zero(s, d):
    price = F.when(F.col("o_orderstatus") != "P", cents(F.col("o_totalprice")))
    return orders(s, d).groupBy("o_custkey").agg(F.floor(stats.mean_null_as_zero(price)).cast("long").alias("mean"))


@query("""SELECT type, count(*) AS documents, CAST(sum(length(body) * 2 + 64) AS BIGINT) AS bytes FROM
(SELECT 'CUER' AS type, c_name AS body FROM customer UNION ALL SELECT 'PART', p_name FROM part) GROUP BY type""")
def collection_stats(s, d):
    body = customers(s, d).select(names.key_type(c(ID)).alias("type"), F.col("c_name").alias("body")).unionByName(parts(s, d).select(names.key_type(c(ID)).alias("type"), F.col("p_name").alias("body")))
    return stats.collection_stats(body)


@query(f"SELECT c_custkey, {CENTS.format('c_acctbal')} AS balance FROM customer ORDER BY c_acctbal, c_custkey")
def sort_collection(s, d):
    return customers(s, d).orderBy("c_acctbal", "c_custkey").select("c_custkey", cents(F.col("c_acctbal")).alias("balance"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def paginate(s, d):
    return select.page(customers(s, d), [F.col("c_custkey")], 3, 50).select("c_custkey", "c_name")


EVICT = """WITH u AS (SELECT 'USER_' || user_id AS key, CAST(sum(length(props) * 2 + 64) AS BIGINT) AS size, epoch_us(max(ts)) // 1000 AS last_access, count(*) AS n, user_id % 7 = 0 AS dirty FROM events GROUP BY user_id),
s AS (SELECT *, last_access * ln(n + 1) AS score FROM u),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY score, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM s WHERE NOT dirty)
SELECT key, size FROM r WHERE (SELECT sum(size) FROM u) > 400000 AND freed < (SELECT sum(size) FROM u) - 320000"""


@query(EVICT)
def eviction_candidates(s, d):
    e = read_table(s, d, "events")
    entries = e.groupBy("user_id").agg(F.sum(stats.body_size(F.col("props"))).alias("size"), F.unix_millis(F.max("ts").cast("timestamp")).alias("last_access"), F.count("*").alias("access_count"))
    entries = entries.select(names.make_key("USER", F.col("user_id")).alias("key"), "size", "last_access", "access_count", (F.col("user_id") % 7 == 0).alias("dirty"))
    return stats.eviction_candidates(entries, 500_000).select("key", "size")


# ---- functions -------------------------------------------------------------------------------

NAMES = ["user", "userS", "account", "order", "a", "item123", "123user", "users", "user-name", "user_name", ""]
VALUES = ", ".join(f"('{n}')" for n in NAMES)


def named(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n,) for n in NAMES], "name string")


@query(f"""SELECT name, upper(substr(b, 1, 2) || right(b, 2)) AS code FROM (SELECT name, regexp_replace(name, 'S$', '') AS b FROM (VALUES {VALUES}) t(name))""")
def fn_type_short(s, d):
    return named(s).select("name", names.short_code_col(F.col("name")).alias("code"))


@query(f"SELECT name, regexp_matches(name, '^[a-z0-9]*[a-rt-z0-9]S?$') AS valid FROM (VALUES {VALUES}) t(name)")
def fn_valid_name(s, d):
    return named(s).select("name", names.valid_name_col(F.col("name")).alias("valid"))


KEYS = ["POST_fu352dp", "X:POST_fu352dp:X", "NOUNDER", "A_b_c"]


@query(f"""SELECT key, split_part(b, '_', 1) AS type, CASE WHEN instr(b, '_') > 0 THEN substr(b, instr(b, '_') + 1) ELSE b END AS id, regexp_matches(key, '^X:.*:X$') AS deleted
FROM (SELECT key, regexp_replace(key, '^X:(.*):X$', '\\1') AS b FROM (VALUES {", ".join(f"('{k}')" for k in KEYS)}) t(key))""")
def fn_key_parts(s, d):
    k = s.createDataFrame([(k,) for k in KEYS], "key string")
    return k.select("key", names.key_type(F.col("key")).alias("type"), names.key_id(F.col("key")).alias("id"), names.is_deleted(F.col("key")).alias("deleted"))


PATHS = [(1, [], []), (2, ["a", "b"], ["a"]), (3, ["a/b", "c~d"], ["a/b", "c~d"]), (4, ["x"], ["y"]), (5, ["a"], ["a", "b"])]


def listed(s: SparkSession) -> DataFrame:
    return s.createDataFrame(PATHS, "i int, p array<string>, q array<string>")


PVALUES = "(VALUES " + ", ".join(f"({i}, {p or '[]::VARCHAR[]'}, {q or '[]::VARCHAR[]'})" for i, p, q in PATHS) + ") t(i, p, q)"


@query(f"""SELECT i, CASE WHEN len(p) = 0 THEN '' ELSE '/' || array_to_string(list_transform(p, lambda x: replace(replace(x, '~', '~0'), '/', '~1')), '/') END AS pointer FROM {PVALUES}""")
def json_pointer(s, d):
    return listed(s).select("i", paths.pointer(F.col("p")).alias("pointer"))


@query(f"SELECT i, p[1:len(q)] = q AS starts FROM {PVALUES}")
def path_prefix(s, d):
    return listed(s).select("i", paths.path_starts_with(F.col("p"), F.col("q")).alias("starts"))


@query(f"SELECT i, p = q AS equal FROM {PVALUES}")
def path_equals(s, d):
    return listed(s).select("i", paths.path_equals(F.col("p"), F.col("q")).alias("equal"))


def user_values(s: SparkSession, d: str) -> DataFrame:
    e = typed_events(s, d)
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("data.k").alias("k")))), lambda x: x["k"]).alias("v"))


UV = "WITH u AS (SELECT user_id, list(CAST(json_extract(props, '$.k') AS BIGINT) ORDER BY event_id) AS v FROM events GROUP BY user_id) "


@query(UV + """SELECT user_id, CAST(list_sum(list_transform(v, lambda x: x * 2)) AS BIGINT) AS doubled, CAST(len(list_filter(v, lambda x: x > 50)) AS BIGINT) AS big, list_filter(v, lambda x: x > 50)[1] AS first_big,
CAST(coalesce(list_position(v, 7), 0) - 1 AS BIGINT) AS at_seven, list_contains(v, 7) AS has_seven, len(list_filter(v, lambda x: x > 90)) > 0 AS some_big, len(list_filter(v, lambda x: x < 0)) = 0 AS none_negative, array_to_string(v, '-') AS joined FROM u""")
def array_hof(s, d):
    v = F.col("v")
    return user_values(s, d).select(
        "user_id", F.aggregate(F.transform(v, lambda x: x * 2), F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"), F.size(F.filter(v, lambda x: x > 50)).cast("long").alias("big"), arrays.find(v, lambda x: x > 50).alias("first_big"),
        arrays.index_of(v, 7).cast("long").alias("at_seven"), F.array_contains(v, F.lit(7).cast("long")).alias("has_seven"), F.exists(v, lambda x: x > 90).alias("some_big"), F.forall(v, lambda x: x >= 0).alias("none_negative"),
        F.array_join(v.cast("array<string>"), "-").alias("joined"),
    )


@query(UV + """SELECT user_id, array_to_string(list_concat(v, [1, 2]), '-') AS pushed, array_to_string(v[:-2], '-') AS popped, array_to_string(v[2:], '-') AS shifted, array_to_string(list_concat([9], v), '-') AS unshifted,
array_to_string(list_concat(v[:1], [5], v[4:]), '-') AS spliced FROM (SELECT user_id, v FROM u)""".replace("v[:-2]", "v[1:len(v) - 1]"))
def array_mutate(s, d):
    v, text = F.col("v"), lambda a: F.array_join(a.cast("array<string>"), "-")
    return user_values(s, d).select(
        "user_id", text(arrays.push(v, 1, 2)).alias("pushed"), text(arrays.pop(v)).alias("popped"), text(arrays.shift(v)).alias("shifted"), text(arrays.unshift(v, 9)).alias("unshifted"), text(arrays.splice(v, 1, 2, 5)).alias("spliced")
    )


# ---- the log as lines ------------------------------------------------------------------------


def log_lines(s: SparkSession, d: str) -> DataFrame:
    """(user_id, line, json) of the events."""
    return read_table(s, d, "events").select("user_id", F.col("event_id").alias("line"), F.concat_ws(":", "event_type", "props").alias("json"))


@query("SELECT event_id AS line, left(sha256('00000000' || event_type || ':' || props), 8) AS pointer FROM events")
def hash_pointer(s, d):
    return log_lines(s, d).select("line", changelog.pointer_of(F.lit("00000000"), F.col("json")).alias("pointer"))


def text_lines(s: SparkSession, d: str) -> DataFrame:
    """(line, value): text lines of a log, every hundredth one corrupt."""
    e = read_table(s, d, "events")
    json = F.to_json(F.struct(F.lit("SET").alias("action"), names.make_key("USER", F.col("user_id")).alias("target"), F.col("props").alias("value")))
    text = changelog.format_line(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("00000000"), json)
    return e.select((F.col("event_id") + 1).alias("line"), F.when(F.col("event_id") % 100 == 99, F.concat(F.lit("broken|"), F.col("props"))).otherwise(text).alias("value"))


@query("SELECT event_id + 1 AS line, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ts, 'SET' AS action, 'USER_' || user_id AS target, props AS value FROM events WHERE event_id % 100 <> 99")
def wal_parse_line(s, d):
    return changelog.parse_lines(text_lines(s, d)).where("ok").select("line", "ts", "action", "target", "value")


@query("SELECT event_id + 1 AS line, 'USER_' || user_id AS target FROM events WHERE event_id % 100 <> 99 AND event_id + 1 > 500")
def wal_scan_after_line(s, d):
    return changelog.scan_after(changelog.parse_lines(text_lines(s, d)), 500).select("line", "target")


@query("SELECT coalesce(max(event_id + 1), 0) AS line FROM events WHERE event_id % 100 <> 99")
def wal_line_count(s, d):
    return changelog.line_count(changelog.parse_lines(text_lines(s, d)))


SEGMENT = 500
CHAIN = f"WITH l AS (SELECT event_id // {SEGMENT} AS segment, list(event_type || ':' || props ORDER BY event_id) AS l, max(event_id) AS line FROM events GROUP BY segment) "


def segments(s: SparkSession, d: str) -> DataFrame:
    return changelog.by_lines(log_lines(s, d), SEGMENT)


@query(CHAIN + "SELECT segment, CAST(len(l) AS BIGINT) AS lines, list_reduce(list_prepend('', l), lambda a, x: left(sha256(a || x), 8)) AS pointer FROM l")
def wal_chain_build(s, d):
    return changelog.chain_ends(segments(s, d), ["segment"])


@query(CHAIN + "SELECT segment, line, list_reduce(list_prepend('', l), lambda a, x: left(sha256(a || x), 8)) AS pointer FROM l")
def wal_last_pointer(s, d):
    return changelog.last_pointer(changelog.build_chain(segments(s, d), ["segment"]).withColumn("ok", F.lit(True)), ["segment"])


@query(f"SELECT line FROM (SELECT event_id AS line, lag(event_id) OVER (PARTITION BY event_id // {SEGMENT} ORDER BY event_id) AS before FROM events) WHERE line % 97 = 0 OR before % 97 = 0")
def wal_verify(s, d):
    """A chain in which some pointers were changed: they and their successors do not fit."""
    chain = changelog.build_chain(segments(s, d), ["segment"])
    bad = chain.withColumn("pointer", F.when(F.col("line") % 97 == 0, F.lit("BADPTR00")).otherwise(F.col("pointer")))
    return changelog.verify(bad, ["segment"]).select("line")


# ---- replay ----------------------------------------------------------------------------------


def event_log(s: SparkSession, d: str) -> DataFrame:
    """A deterministic mutation log from the events; lines are even, renames odd."""
    e = read_table(s, d, "events")
    kind, key = F.col("event_type"), names.make_key("USER", F.col("user_id"))
    grown = F.replace(F.col("props"), F.lit("}"), F.concat(F.lit(', "e": '), F.col("event_id").cast("string"), F.lit("}")))
    is_set = kind.isin("purchase", "error")
    action = F.when(kind.isin("view", "click"), "SET").when(kind == "purchase", "SADD").when(kind == "error", "SREM").otherwise("DELETE")
    null = F.lit(None).cast("string")
    log = e.select(
        (F.col("event_id") * 2).alias("line"), "ts", action.alias("action"), F.when(is_set, F.lit("BUYS?")).otherwise(key).alias("target"), null.alias("old_key"),
        F.when(is_set, key).alias("member"), F.when(kind == "view", F.col("props")).when(kind == "click", grown).alias("value"),
    )
    last = e.where((kind == "error") & (F.col("user_id") % 10 == 0)).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("ts", "event_id").alias("ts"))
    moved = last.select((F.col("event_id") * 2 + 1).alias("line"), "ts", F.lit("RENAME").alias("action"), names.make_key("VIPS", F.col("user_id")).alias("target"), names.make_key("USER", F.col("user_id")).alias("old_key"), null.alias("member"), null.alias("value"))
    return log.unionByName(moved)


LOG = """WITH log AS (SELECT event_id * 2 AS line, ts, CASE event_type WHEN 'view' THEN 'SET' WHEN 'click' THEN 'SET' WHEN 'purchase' THEN 'SADD' WHEN 'error' THEN 'SREM' ELSE 'DELETE' END AS action,
 CASE WHEN event_type IN ('purchase', 'error') THEN 'BUYS?' ELSE 'USER_' || user_id END AS target, CASE WHEN event_type IN ('purchase', 'error') THEN 'USER_' || user_id END AS member,
 CASE event_type WHEN 'view' THEN props WHEN 'click' THEN replace(props, '}', ', "e": ' || event_id || '}') END AS value FROM events),
rn AS (SELECT max(event_id) * 2 + 1 AS line, 'USER_' || user_id AS old, 'VIPS_' || user_id AS new FROM events WHERE event_type = 'error' AND user_id % 10 = 0 GROUP BY user_id),
ops AS (SELECT target AS key, line, action, value FROM log WHERE action IN ('SET', 'DELETE')),
held AS (SELECT old, new, r.line, arg_max({'a': action, 'v': value}, o.line) AS p FROM rn r JOIN ops o ON o.key = r.old AND o.line < r.line GROUP BY old, new, r.line),
moved AS (SELECT * FROM ops UNION ALL SELECT old, line, 'DELETE', NULL FROM held WHERE p.a = 'SET' UNION ALL SELECT new, line, 'SET', p.v FROM held WHERE p.a = 'SET'),
"""
LAST = "SELECT key, arg_max({'a': action, 'v': value}, line) AS p, max(line) AS line FROM {0}"
STATE = "SELECT key, p.v AS value FROM (" + LAST + " GROUP BY key) WHERE p.a = 'SET'"


def state_sql(source: str) -> str:
    return STATE.replace("{0}", source)


def plain(log: DataFrame) -> DataFrame:
    return log.where("action <> 'RENAME'")


@query(LOG + "z AS (SELECT 1) " + state_sql("ops"))
def wal_replay_state(s, d):
    return replay.documents(plain(event_log(s, d)), renames=False).select("key", "value")


@query(LOG + "z AS (SELECT 1) SELECT key FROM (" + LAST.replace("{0}", "ops") + " GROUP BY key) WHERE p.a = 'DELETE'")
def wal_delete(s, d):
    log = plain(event_log(s, d))
    written = log.where("action in ('SET', 'DELETE')").select(F.col("target").alias("key")).distinct()
    return written.join(replay.documents(log, renames=False), "key", "left_anti")


@query(LOG + "z AS (SELECT 1) " + state_sql("moved"))
def wal_rename(s, d):
    return replay.documents(event_log(s, d)).select("key", "value")


@query("SELECT 'H' || (count(*) - 1) || '_' || user_id AS key, arg_min(props, event_id) AS value FROM events GROUP BY user_id")
def wal_rename_chain(s, d):
    """Every user's first event makes a document, and each later one renames it."""
    e = read_table(s, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    hop = lambda i: F.concat(F.lit("H"), i.cast("string"), F.lit("_"), F.col("user_id").cast("string"))
    null = F.lit(None).cast("string")
    log = e.withColumn("n", n).select(
        F.col("event_id").alias("line"), F.when(F.col("n") == 0, "SET").otherwise("RENAME").alias("action"), hop(F.col("n")).alias("target"), F.when(F.col("n") > 0, hop(F.col("n") - 1)).alias("old_key"),
        null.alias("member"), F.when(F.col("n") == 0, F.col("props")).alias("value"),
    )
    return replay.documents(log).select("key", "value")


SETS = "SELECT target AS set_name, member FROM (SELECT target, member, arg_max(action, line) AS a FROM log WHERE action IN ('SADD', 'SREM') GROUP BY target, member) WHERE a = 'SADD'"


@query(LOG + "z AS (SELECT 1) " + SETS)
def wal_set_state(s, d):
    return replay.sets(event_log(s, d))


@query(LOG + f"z AS ({SETS}) SELECT set_name, count(*) AS members FROM z GROUP BY set_name")
def set_members(s, d):
    return replay.sets(event_log(s, d)).groupBy("set_name").agg(F.count("*").alias("members"))


def half(s: SparkSession, d: str) -> int:
    return read_table(s, d, "events").agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]


@query(LOG + "z AS (SELECT 1) " + state_sql("moved"))
def snapshot_plus_tail(s, d):
    log, line = event_log(s, d), half(s, d)
    return replay.from_snapshot(replay.as_of(log, line), line, log).select("key", "value")


@query(LOG + "z AS (SELECT 1) " + state_sql("(SELECT * FROM ops WHERE line <= (SELECT max(event_id) FROM events))"))
def snapshot_roundtrip(s, d):
    folder, line = files.work_dir(s), half(s, d)
    files.write_snapshot(replay.documents(plain(event_log(s, d)).where(F.col("line") <= line), renames=False), folder, line)
    return files.read_snapshot(s, folder)[0]


@query(LOG + "z AS (SELECT 1) " + state_sql("(SELECT * FROM moved WHERE line <= (SELECT max(event_id) FROM events))"))
def state_as_of(s, d):
    return replay.as_of(event_log(s, d), half(s, d)).select("key", "value")


# ---- transactions ----------------------------------------------------------------------------

CUT_SQL = f"TIMESTAMP '{CUT}'"
TXN = LOG + f"""base AS (SELECT key, p.v AS value FROM ({LAST.replace('{0}', f"(SELECT target AS key, line, action, value FROM log WHERE action IN ('SET', 'DELETE') AND ts < {CUT_SQL})")} GROUP BY key) WHERE p.a = 'SET'),
acts AS (SELECT * FROM log WHERE ts >= {CUT_SQL}),
own AS ({LAST.replace('{0}', "(SELECT target AS key, line, action, value FROM acts WHERE action IN ('SET', 'DELETE'))")} GROUP BY key),
over AS (SELECT coalesce(b.key, o.key) AS key, CASE WHEN o.key IS NOT NULL THEN o.p.v ELSE b.value END AS value FROM base b FULL JOIN own o ON b.key = o.key WHERE o.key IS NULL OR o.p.a = 'SET'),
bset AS (SELECT target AS set_name, member FROM (SELECT target, member, arg_max(action, line) AS a FROM log WHERE action IN ('SADD', 'SREM') AND ts < {CUT_SQL} GROUP BY target, member) WHERE a = 'SADD'),
oset AS (SELECT target AS set_name, member, arg_max(action, line) AS a FROM acts WHERE action IN ('SADD', 'SREM') GROUP BY target, member)
"""


def split_log(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(committed log, actions of an open transaction)."""
    log, cut = plain(event_log(s, d)), F.lit(CUT).cast("timestamp_ntz")
    return log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut)


@query(TXN + "SELECT key, value FROM over")
def txn_overlay_read(s, d):
    log, acts = split_log(s, d)
    return txn.overlay(replay.documents(log, renames=False), acts)


@query(TXN + "SELECT key, c_name FROM over LEFT JOIN customer ON substr(key, 6) = CAST(c_custkey AS VARCHAR)")
def txn_populate(s, d):
    log, acts = split_log(s, d)
    seen = txn.overlay(replay.documents(log, renames=False), acts).withColumn("customer", F.concat(F.lit("CUER_"), names.key_id(F.col("key"))))
    return refs.populate(seen, "customer", customers(s, d)).select("key", F.col("customer.c_name").alias("c_name"))


@query(TXN + "SELECT key, value FROM base")
def txn_isolation(s, d):
    """What others see while the transaction is open."""
    return replay.documents(split_log(s, d)[0], renames=False).select("key", "value")


@query(TXN + "SELECT action, target, member, value FROM (SELECT p.a AS action, key AS target, NULL AS member, p.v AS value FROM own UNION ALL SELECT a, set_name, member, NULL FROM oset)")
def txn_squash(s, d):
    log, acts = split_log(s, d)
    return txn.squash(acts, replay.documents(log, renames=False)).select("action", "target", "member", "value")


@query(TXN + "SELECT key, value FROM over")
def txn_commit(s, d):
    log, acts = split_log(s, d)
    done = txn.commit(log, acts, replay.documents(log, renames=False), 1 << 60)
    return replay.documents(done, renames=False).select("key", "value")


@query(TXN + "SELECT key, value FROM base")
def txn_rollback(s, d):
    log, acts = split_log(s, d)
    return txn.overlay(replay.documents(log, renames=False), acts.limit(0)).select("key", "value")


@query(TXN + f""", o2 AS ({LAST.replace('{0}', "(SELECT target AS key, line, action, value FROM acts WHERE action IN ('SET', 'DELETE') AND line < (SELECT max(line) FROM acts))")} GROUP BY key)
SELECT coalesce(b.key, o.key) AS key, CASE WHEN o.key IS NOT NULL THEN o.p.v ELSE b.value END AS value FROM base b FULL JOIN o2 o ON b.key = o.key WHERE o.key IS NULL OR o.p.a = 'SET'""")
def txn_pop(s, d):
    log, acts = split_log(s, d)
    return txn.overlay(replay.documents(log, renames=False), txn.pop(acts))


@query(TXN + "SELECT count(*) AS actions, count(DISTINCT CASE WHEN action = 'SET' THEN target END) AS documents, count(DISTINCT CASE WHEN member IS NOT NULL THEN target END) AS collections FROM acts")
def txn_status(s, d):
    return txn.status(split_log(s, d)[1]).select("actions", "documents", "collections")


@query(LOG + f"""acts AS (SELECT *, 'txn_' || (line / 2) % 5 AS txn_id FROM log WHERE ts >= {CUT_SQL} AND action IN ('SET', 'DELETE'))
SELECT txn_id, key, p.a AS action, p.v AS value FROM (SELECT txn_id, target AS key, arg_max({{'a': action, 'v': value}}, line) AS p FROM acts GROUP BY txn_id, target)""".replace("(line / 2) % 5", "CAST((line // 2) % 5 AS VARCHAR)"))
def txn_recover(s, d):
    acts = split_log(s, d)[1].withColumn("txn_id", F.concat(F.lit("txn_"), (F.expr("line div 2") % 5).cast("string")))
    return txn.recover(acts)


@query(TXN + "SELECT set_name, member FROM bset UNION SELECT set_name, member FROM oset WHERE a = 'SADD'")
def set_union_overlay(s, d):
    log, acts = split_log(s, d)
    return txn.set_overlay(replay.sets(log), acts, subtract=False)


@query(TXN + "SELECT set_name, member FROM (SELECT set_name, member FROM bset UNION SELECT set_name, member FROM oset WHERE a = 'SADD') WHERE (set_name, member) NOT IN (SELECT (set_name, member) FROM oset WHERE a = 'SREM')")
def set_overlay(s, d):
    log, acts = split_log(s, d)
    return txn.set_overlay(replay.sets(log), acts)


# ---- changes ---------------------------------------------------------------------------------


def versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and customers after some changes: renamed, moved, without name, gone, new."""
    old = read_table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    new = old.where(k % 11 != 0).select(k, F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    extra = old.where(k % 100 == 1).select((-k).alias("c_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    return old, new.unionByName(extra)


VERSIONS = """WITH old AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer),
new AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0
 UNION ALL SELECT -c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 100 = 1),
fo AS (SELECT c_custkey, '/c_name' AS path, c_name AS value FROM old UNION ALL SELECT c_custkey, '/c_nationkey', CAST(c_nationkey AS VARCHAR) FROM old UNION ALL SELECT c_custkey, '/c_mktsegment', c_mktsegment FROM old),
fn AS (SELECT c_custkey, '/c_name' AS path, c_name AS value FROM new UNION ALL SELECT c_custkey, '/c_nationkey', CAST(c_nationkey AS VARCHAR) FROM new UNION ALL SELECT c_custkey, '/c_mktsegment', c_mktsegment FROM new),
diff AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'remove' ELSE 'replace' END AS op, b.value AS value
 FROM (SELECT * FROM fo WHERE value IS NOT NULL) a FULL JOIN (SELECT * FROM fn WHERE value IS NOT NULL) b ON a.c_custkey = b.c_custkey AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value) """


@query(VERSIONS + "SELECT c_custkey, path, value FROM fn WHERE value IS NOT NULL")
def flatten_paths(s, d):
    return paths.flatten_paths(versions(s, d)[1], "c_custkey").select("c_custkey", paths.pointer(F.col("path")).alias("path"), "value")


@query(VERSIONS + "SELECT c_custkey, op, path, value FROM diff")
def diff_patch(s, d):
    return changes.patch(*versions(s, d), key="c_custkey")


@query(VERSIONS + "SELECT c_custkey, path, value FROM fn WHERE value IS NOT NULL")
def apply_changes(s, d):
    """The patch between two states, applied to the old one, is the new one."""
    old, new = versions(s, d)
    flat = paths.flatten_paths(old, "c_custkey").select("c_custkey", paths.pointer(F.col("path")).alias("path"), "value")
    return changes.apply_patch(flat, changes.patch(old, new, "c_custkey"), "c_custkey")


@query(VERSIONS + "SELECT 'CUER_' || c_custkey AS target, 'CUER' AS type, string_agg(op || path, ',' ORDER BY path) AS ops FROM diff GROUP BY c_custkey")
def change_events(s, d):
    old, new = versions(s, d)
    diff = changes.patch(old, new, "c_custkey").withColumn("id", names.make_key("CUER", F.col("c_custkey")))
    e = changes.events(diff, "id", F.lit("UPDATE"), F.lit("2024-02-01 00:00:00").cast("timestamp"), "USER_1", "sync")
    return e.select("target", "type", F.array_join(F.transform("patches", lambda p: F.concat(p["op"], p["path"])), ",").alias("ops"))


@query("""SELECT user_id, event_id, CASE WHEN was IS NULL THEN 'add' ELSE 'replace' END AS op, k AS value FROM
(SELECT user_id, event_id, json_extract_string(props, '$.k') AS k, lag(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS DISTINCT FROM k""")
def version_diff(s, d):
    """What each version of a user's document changes against the one before."""
    k = F.get_json_object("props", "$.k")
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = read_table(s, d, "events").select("user_id", "event_id", k.alias("value"), F.lag(k).over(w).alias("was"))
    return v.where(~F.col("was").eqNullSafe(F.col("value"))).select("user_id", "event_id", F.when(F.col("was").isNull(), "add").otherwise("replace").alias("op"), "value")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_field(s, d):
    return changes.drop_path(versions(s, d)[0], ["c_mktsegment"])


AT = "2024-02-01 00:00:00"
THEN = "2024-01-01 00:00:00"


def stored(s: SparkSession, d: str) -> DataFrame:
    at = F.lit(THEN).cast("timestamp")
    return customers(s, d).select(ID, "c_custkey", "c_name", "c_nationkey", at.alias("createdAt"), at.alias("updatedAt"))


def shown(df: DataFrame, *more: str) -> DataFrame:
    millis = [F.unix_millis(x).alias(x) for x in ("createdAt", "updatedAt") if x in df.columns]
    return df.select(c(ID).alias("id"), "c_name", "c_nationkey", *millis, *more)


MS_AT, MS_THEN = 1706745600000, 1704067200000


@query(f"SELECT 'CUER_' || (c_custkey + 1000000000) AS id, c_name, c_nationkey, {MS_AT}::BIGINT AS \"createdAt\", {MS_AT}::BIGINT AS \"updatedAt\" FROM customer")
def add_documents(s, d):
    rows = read_table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return shown(changes.add_documents(rows, "CUER", F.lit(AT).cast("timestamp"), F.col("c_custkey") + 1000000000))


@query(f"""SELECT 'CUER_' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_nationkey END AS c_nationkey, {MS_THEN}::BIGINT AS "createdAt",
CASE WHEN (c_custkey % 4 = 0 AND c_name IS NOT NULL) OR (c_custkey % 6 = 0 AND c_nationkey <> 0) THEN {MS_AT}::BIGINT ELSE {MS_THEN}::BIGINT END AS "updatedAt" FROM customer""")
def update_overlay(s, d):
    base, k = stored(s, d), F.col("c_custkey")
    declared = F.filter(F.array(F.when(k % 4 == 0, F.lit("c_name")), F.when(k % 6 == 0, F.lit("c_nationkey"))), lambda x: x.isNotNull())
    new = base.where((k % 4 == 0) | (k % 6 == 0)).select(ID, declared.alias("_declared"), F.lit(None).cast("string").alias("c_name"), F.lit(0).alias("c_nationkey"))
    return shown(changes.update_documents(base, new, F.lit(AT).cast("timestamp")))


@query(f"""SELECT 'CUER_' || c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE c_nationkey END AS c_nationkey, {MS_THEN}::BIGINT AS "createdAt",
CASE WHEN c_custkey % 9 = 0 THEN {MS_AT}::BIGINT ELSE {MS_THEN}::BIGINT END AS "updatedAt" FROM customer""")
def replace_documents(s, d):
    base = stored(s, d)
    rows = base.where("c_custkey % 9 = 0").select(ID, "c_custkey", F.lit("new").alias("c_name"), F.lit(1).alias("c_nationkey"))
    return shown(changes.replace_documents(base, rows, F.lit(AT).cast("timestamp")))


def deleted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = stored(s, d)
    return changes.soft_delete(base, base.where("c_custkey % 10 = 3").select(ID), "USER_1", F.lit(AT).cast("timestamp"))


@query("SELECT 'CUER_' || c_custkey AS id, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 3")
def soft_delete(s, d):
    return shown(deleted(s, d)[0].drop("createdAt", "updatedAt"))


@query(f"SELECT 'X:CUER_' || c_custkey || ':X' AS id, c_name, c_nationkey, 'USER_1' AS \"deletedBy\", 'CUER_' || c_custkey AS bare, {MS_AT}::BIGINT AS deleted_ms FROM customer WHERE c_custkey % 10 = 3")
def deleted_view(s, d):
    dead = deleted(s, d)[1].where(names.is_deleted(c(ID))).drop("createdAt", "updatedAt")
    return shown(dead.withColumn("bare", names.bare_key(c(ID))).withColumn("deleted_ms", F.unix_millis("deletedAt")), "deletedBy", "bare", "deleted_ms")


@query("SELECT 'CUER_' || c_custkey AS id, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 3 OR c_custkey % 20 = 13")
def restore_deleted(s, d):
    live, dead = deleted(s, d)
    back = stored(s, d).where("c_custkey % 20 = 13").select(ID)
    return shown(changes.restore(live, dead, back).drop("createdAt", "updatedAt"))


# ---- validation, codec, encryption -----------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'text is required' WHEN lang IS NULL THEN 'lang is required' WHEN lang NOT IN ('en', 'de') THEN 'lang must be one of en, de' WHEN n_chars IS NULL THEN 'n_chars is required' END AS error FROM documents""")
def validate_rows(s, d):
    rules = {"text": Rule("string"), "lang": Rule("string", enum=["en", "de"]), "n_chars": Rule("number"), "nick": Rule("string", required=False)}
    return validate(read_table(s, d, "documents"), rules).select("doc_id", "error")


@query("SELECT doc_id, CASE WHEN NOT regexp_matches(text, '[^\\t\\n\\x0B\\f\\r ]+@[^\\t\\n\\x0B\\f\\r ]+\\.[^\\t\\n\\x0B\\f\\r ]+') THEN 'text must be of type email' END AS error FROM documents")
def validate_email(s, d):
    return validate(read_table(s, d, "documents"), {"text": Rule("email", required=False)}).select("doc_id", "error")


@query("SELECT doc_id, CASE WHEN quality NOT IN (1) THEN 'quality must be one of 1' WHEN toxic NOT IN (0) THEN 'toxic must be one of 0' END AS error FROM labels")
def validate_enum(s, d):
    return validate(read_table(s, d, "labels"), {"quality": Rule("number", required=False, enum=[1]), "toxic": Rule("number", required=False, enum=[0])}).select("doc_id", "error")


@query(LISTS + "SELECT o_custkey, CASE WHEN len(list_filter(l, lambda x: x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) > 0 THEN 'l[] must be one of 1-URGENT, 2-HIGH, 3-MEDIUM' END AS error FROM p")
def validate_items(s, d):
    rule = Rule("array", items=Rule("string", enum=["1-URGENT", "2-HIGH", "3-MEDIUM"]))
    return validate(priority_lists(s, d), {"l": rule}).select("o_custkey", "error")


@query("SELECT p_partkey, substr(upper(p_name), 1, 4) AS code, NULL::VARCHAR AS error FROM part")
def validate_transform(s, d):
    df = read_table(s, d, "part").select("p_partkey", F.col("p_name").alias("code"))
    return validate(df, {"code": Rule("string", get=F.upper, set=lambda x: F.substring(x, 1, 4))}).select("p_partkey", "code", "error")


ORDER = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderstatus", T.StringType())])


def encoded(s: SparkSession, d: str) -> DataFrame:
    df = read_table(s, d, "orders").select(*ORDER.names)
    return df.select("o_orderkey", codec.encode(df.schema).alias("body"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS date_ms, o_orderstatus AS status FROM orders")
def tagged_json_encode(s, d):
    return encoded(s, d).select("o_orderkey", F.get_json_object("body", "$['o_orderdate<!D>']").cast("long").alias("date_ms"), F.get_json_object("body", "$.o_orderstatus").alias("status"))


@query("SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS date FROM orders")
def tagged_json_decode(s, d):
    return encoded(s, d).select("o_orderkey", codec.decode(F.col("body"), ORDER).alias("r")).select("o_orderkey", F.date_format("r.o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("SELECT count(*) AS n, count(*) AS same FROM orders")
def tagged_json_roundtrip(s, d):
    both = encoded(s, d).select("o_orderkey", codec.decode(F.col("body"), ORDER).alias("r")).join(read_table(s, d, "orders"), "o_orderkey")
    same = (F.col("r.o_orderdate") == F.col("o_orderdate")) & (F.col("r.o_orderstatus") == F.col("o_orderstatus"))
    return both.agg(F.count("*").alias("n"), F.count_if(same).alias("same"))


@query("SELECT r_regionkey, to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS body FROM region".replace("to_json(", "CAST(to_json(").replace("}) AS", "}) AS VARCHAR) AS"))
def to_json_rows(s, d):
    return read_table(s, d, "region").select("r_regionkey", F.to_json(F.struct("r_regionkey", "r_name")).alias("body"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def encrypt_roundtrip(s, d):
    aad = changelog.format_line(F.col("doc_id").cast("string"), F.lit("00000000"), F.lit(""))
    sealed = read_table(s, d, "documents").select("doc_id", aad.alias("aad"), crypto.encrypt(F.col("text"), KEY, aad).alias("sealed"))
    return sealed.select("doc_id", F.md5(crypto.decrypt(F.col("sealed"), KEY, F.col("aad")).cast("binary")).alias("digest"))


@query()
def id_generation(s, d):
    """Ids of the id alphabet for all documents (repeatable, so rows-only in the driver's check)."""
    return read_table(s, d, "documents").select("doc_id", F.concat(F.lit("DONT_"), names.derived_id(F.col("doc_id"), F.col("source"))).alias("id"))


# ---- streams and graphs ----------------------------------------------------------------------


def event_stream(s: SparkSession, d: str) -> DataFrame:
    return subscribe.read_log(s, f"{d}/events*.parquet", read_table(s, d, "events").schema)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_subscribe(s, d):
    """Batches of one kind of event, taken by a callback into a table."""
    folder = files.work_dir(s)
    log = event_stream(s, d).withColumn("target", F.concat(F.upper("event_type"), F.lit("_"), F.col("user_id"))).select("event_id", "user_id", "target")
    subscribe.subscribe(log, "PURCHASE", subscribe.into(f"{folder}/rows"), f"{folder}/checkpoint", once=True).awaitTermination()
    return subscribe.stored(s, log.schema, folder).select("event_id", "user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id")
def stream_state_lww(s, d):
    return subscribe.table(subscribe.latest(event_stream(s, d), "user_id", ["event_type", "props"], "event_id"), "update", files.work_dir(s), ["user_id"])


@query("SELECT event_id, user_id FROM events")
def stream_dedup(s, d):
    """Every event arrives twice and is kept once."""
    twice = timed_stream(s, d).withColumn("_", F.explode(F.array(F.lit(1), F.lit(2))))
    return subscribe.table(subscribe.without_repeats(twice, ["event_id"], "ts", "365 days").select("event_id", "user_id"), "append", files.work_dir(s))


def timed_stream(s: SparkSession, d: str) -> DataFrame:
    return event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(s: SparkSession, d: str, window, by: list[str]) -> DataFrame:
    rows = subscribe.table(subscribe.counts(timed_stream(s, d), window, by, "ts", "1 day"), "complete", files.work_dir(s))
    return rows.select(*[F.unix_millis(x).alias(f"{x}_ms") for x in ("start", "end")], *by, "n")


@query("SELECT epoch_ms(date_trunc('day', ts)) AS start_ms, epoch_ms(date_trunc('day', ts)) + 86400000 AS end_ms, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    return windowed(s, d, F.window("ts", "1 day"), ["event_type"])


@query("""SELECT w AS start_ms, w + 86400000 AS end_ms, event_type, count(*) AS n FROM
(SELECT event_type, unnest([epoch_ms(ts) // 43200000 * 43200000, epoch_ms(ts) // 43200000 * 43200000 - 43200000]) AS w FROM events) GROUP BY ALL""")
def stream_sliding(s, d):
    return windowed(s, d, F.window("ts", "1 day", "12 hours"), ["event_type"])


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
n AS (SELECT user_id, t, sum(CASE WHEN b IS NULL OR t - b > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM g)
SELECT min(t) // 1000 AS start_ms, (max(t) + 21600000000) // 1000 AS end_ms, user_id, count(*) AS n FROM n GROUP BY user_id, k""")
def stream_session(s, d):
    return windowed(s, d, F.session_window("ts", "6 hours"), ["user_id"])


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def graph_find(s, d):
    found = refs.find_paths([customers(s, d).select(c(ID).alias("src"), F.col("nation").alias("dst")), nations(s, d).select(c(ID).alias("src"), F.col("region").alias("dst"))])
    return found.join(customers(s, d), found["v0"] == c(ID)).join(regions(s, d).select(c(ID).alias("v2"), "r_name"), "v2").select("c_custkey", "r_name")


@query("""SELECT 'REON_0' AS vertex, 0 AS hops UNION ALL SELECT 'NAON_' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
UNION ALL SELECT 'CUER_' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""")
def graph_walk(s, d):
    edges = nations(s, d).select(F.col("region").alias("src"), c(ID).alias("dst")).unionByName(customers(s, d).select(F.col("nation").alias("src"), c(ID).alias("dst")))
    return refs.walk(edges, s.createDataFrame([("REON_0",)], "v string"))


from . import store_queries  # noqa: E402, F401  its queries register themselves here
