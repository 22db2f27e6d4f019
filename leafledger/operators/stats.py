"""Statistics of collections and the eviction order of a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def body_size(body: Column) -> Column:
    """Estimated bytes of a stored document."""
    return F.length(body) * 2 + 64


def collection_stats(docs: DataFrame) -> DataFrame:
    """(type, documents, bytes) of (type, body) rows."""
    return docs.groupBy("type").agg(F.count("*").alias("documents"), F.sum(body_size(F.col("body"))).alias("bytes"))


def mean_null_as_zero(value: Column) -> Column:
    """Nulls count as 0, in the sum and in the number."""
    return F.sum(F.coalesce(value, F.lit(0))) / F.count("*")


def eviction_candidates(entries: DataFrame, limit: int, threshold: float = 0.8) -> DataFrame:
    """Entries (key, size, last_access, access_count, dirty) to evict, lowest score first.

    Nothing while the sum of sizes is at most ``limit * threshold``; else entries go until
    it is at most 0.8 of that.  Running sums are made in two steps, within score buckets
    and over them, so no task holds all entries.
    """
    score = F.col("last_access") * F.log(F.col("access_count") + 1)
    scored = entries.withColumn("score", score)
    clean = scored.where("not dirty")
    used, low, high = scored.agg(F.sum("size"), F.min(F.when(~F.col("dirty"), F.col("score"))), F.max(F.when(~F.col("dirty"), F.col("score")))).first()
    if low is None or used is None or used <= threshold * limit:
        return clean.limit(0).select("key", "size", "score")
    width = max((high - low) / 1024, 1e-300)
    clean = clean.withColumn("bucket", F.floor((F.col("score") - low) / width).cast("int"))
    sums = clean.groupBy("bucket").agg(F.sum("size").alias("s"))
    # at most 1025 buckets
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = Window.partitionBy("bucket").orderBy("score", "key").rowsBetween(Window.unboundedPreceding, -1)
    run = clean.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(before), "bucket")
    return run.where(F.col("before") + F.col("run") < used - 0.8 * threshold * limit).select("key", "size", "score")
