"""Plans that must hold at any size, and streams that may run a batch twice."""

from pyspark.sql import functions as F

from leafledger.operators import refs, select
from leafledger.plans import queries as q
from leafledger.sources import files
from leafledger.streaming import subscribe


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_lookups_reach_the_scan(spark, sf):
    for name, pushed in (("get_by_id", "EqualTo(o_orderkey,7)"), ("get_by_ids", "In(c_custkey, [3,9,999999999])"), ("get_any_type", "EqualTo(s_suppkey,5)")):
        assert pushed in plan(q.QUERIES[name](spark, sf)), name


def test_references_join_on_integers(spark, sf):
    text = plan(q.populate_deep(spark, sf))
    assert "o_custkey" in text and "Left keys [1]: [n_regionkey" in text and "$ID" not in "".join(x for x in text.splitlines() if "keys [1]" in x)
    assert "c_acctbal" not in text and "c_mktsegment" not in text


def test_odd_ids_and_changed_keys(spark, sf):
    orders = q.orders(spark, sf)
    for wanted in ("ORER_07", "ORER_x", "ORER_9999999999999999999", "ORER_-1", "ORER_ 7"):
        assert select.get_by_id(orders, "ORER", wanted).count() == 0
    moved = orders.withColumn("o_orderkey", F.col("o_orderkey") + 1)  # the ids stay as they were
    assert select.get_by_id(moved, "ORER", "ORER_7").select("o_orderkey").first()[0] == 8
    nations = q.nations(spark, sf)
    shifted = q.customers(spark, sf).withColumn("c_nationkey", F.lit(0))
    a = refs.populate(shifted, "nation", nations).groupBy("nation.n_name").count()
    b = refs.populate(q.customers(spark, sf), "nation", nations).groupBy("nation.n_name").count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_batch_that_runs_twice_counts_once(spark, sf):
    folder = files.work_dir(spark)
    rows = spark.range(10)
    for _ in range(2):
        subscribe.into(f"{folder}/rows")(rows, 0)
    subscribe.into(f"{folder}/rows")(rows, 1)
    assert subscribe.stored(spark, rows.schema, folder).count() == 20
    assert subscribe.stored(spark, rows.schema, folder, "complete").count() == 10


def test_walk_has_no_hidden_limit(spark):
    edges = spark.range(14).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0,)], "v long")
    assert refs.walk(edges, start).agg(F.max("hops")).first()[0] == 14
    assert refs.walk(edges, start, 3).count() == 4


def test_a_chain_goes_on_through_segments(spark):
    from leafledger.plans import changelog

    log = changelog.by_lines(spark.range(1, 30).select(F.col("id").alias("line"), F.col("id").cast("string").alias("json")), 10)
    chain = changelog.build_chain(log, ["segment"])
    assert chain.count() == 29 and changelog.verify(chain, ["segment"]).count() == 0
    assert [r.line for r in changelog.verify(chain, ["segment"], chained_segments=True).orderBy("line").collect()] == [10, 20]
