"""Subscriptions to the change log, and state that follows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.names import key_type


def read_log(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def subscribe(log: DataFrame, code: str, callback: Callable[[DataFrame, int], None], checkpoint: str, key: str = "target", once: bool = False) -> StreamingQuery:
    """Call ``callback(rows, batch)`` with each batch of a collection's entries; ``stop()`` unsubscribes."""
    writer = log.where(key_type(F.col(key)) == code).writeStream.option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(log: DataFrame, key: str, value: list[str], order: str) -> DataFrame:
    """Continuous last-writer-wins state: the values at the largest ``order`` of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*value), order).alias("_v")).select(key, *[F.col(f"_v.{v}").alias(v) for v in value])


def without_repeats(log: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once, however often it arrives within ``late``."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(log: DataFrame, window: Column, by: list[str], time: str, late: str) -> DataFrame:
    """(start, end, ``by``, n): events in tumbling, sliding (``F.window``) or session windows (``F.session_window``)."""
    grouped = log.withWatermark(time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A callback that writes each batch to a folder of its own: a batch that runs again replaces its rows."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def table(df: DataFrame, mode: str, folder: str, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there now into Parquet below ``folder``, and return its rows.

    ``append`` gives all batches' rows; ``update`` the latest row of each ``key``;
    ``complete`` the rows of the last batch.
    """
    q = df.writeStream.foreachBatch(into(f"{folder}/rows")).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stored(df.sparkSession, df.schema, folder, mode, key)


def stored(spark: SparkSession, schema: StructType, folder: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """The rows that ``table`` or ``into`` has written below ``folder``."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]  # from the folders' names and row counts
        rows = rows.where(F.col("batch") == F.lit(last))
    if mode == "update":
        names = [n for n in schema.names if n not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("_v")).select(*key, "_v.*").select(*schema.names)
    return rows.select(*schema.names)
