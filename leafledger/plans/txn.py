"""Transactions: ordered actions over a base, seen as an overlay until they are committed.

Actions have the log's columns, with ``seq`` as ``line``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replay import known


def _touched(actions: DataFrame, base: DataFrame) -> DataFrame:
    """(key, action, value, line): the last SET or DELETE of each key; renames read through to the base."""
    from .replay import last_entries, snapshot_entries

    old = actions.where("action = 'RENAME'").select(F.col("old_key").alias("key")).distinct()
    start = snapshot_entries(base.select("key", "value").join(old, "key", "left_semi"), -1)
    return last_entries(start.unionByName(actions.select(*start.columns))).where("line >= 0")


def overlay(base: DataFrame, actions: DataFrame) -> DataFrame:
    """(key, value) as the transaction sees it: its own writes over the base."""
    own = _touched(actions, base).select("key", F.col("action").alias("_action"), F.col("value").alias("_value"))
    j = base.select("key", "value").join(own, "key", "full").where("_action is null or _action = 'SET'")
    return j.select("key", F.when(F.col("_action") == "SET", F.col("_value")).otherwise(F.col("value")).alias("value"))


def set_overlay(base: DataFrame, actions: DataFrame, subtract: bool = True) -> DataFrame:
    """(set_name, member) as the transaction sees it; ``subtract=False`` is the plain union."""
    ops = known(actions).where(F.col("action").isin("SADD", "SREM"))
    last = ops.groupBy(F.col("target").alias("set_name"), "member").agg(F.max_by("action", "line").alias("a"))
    both = base.select("set_name", "member").unionByName(last.where("a = 'SADD'").select("set_name", "member")).distinct()
    return both.join(last.where("a = 'SREM'"), ["set_name", "member"], "left_anti") if subtract else both


def squash(actions: DataFrame, base: DataFrame) -> DataFrame:
    """(action, target, member, value, n_actions): one final entry for each key and set member touched."""
    n = known(actions).groupBy("target").agg(F.count("*").alias("n_actions"))
    docs = _touched(actions, base).select("action", F.col("key").alias("target"), F.lit(None).cast("string").alias("member"), "value")
    ops = known(actions).where(F.col("action").isin("SADD", "SREM")).groupBy("target", "member").agg(F.max_by("action", "line").alias("action"))
    rows = docs.unionByName(ops.select("action", "target", "member", F.lit(None).cast("string").alias("value")))
    return rows.join(n, "target", "left").select("action", "target", "member", "value", F.coalesce("n_actions", F.lit(0)).alias("n_actions"))


def commit(log: DataFrame, actions: DataFrame, base: DataFrame, line: int) -> DataFrame:
    """The log with the squashed entries after ``line``; all of them are one position, so a commit is seen whole or not at all."""
    new = squash(actions, base).select(F.lit(line).cast("long").alias("line"), "action", "target", F.lit(None).cast("string").alias("old_key"), "member", "value")
    return log.select("line", "action", "target", "old_key", "member", "value").unionByName(new)


def pop(actions: DataFrame, count: int = 1) -> DataFrame:
    """The actions without the last ``count``."""
    cut = actions.orderBy(F.desc("line")).limit(count).agg(F.min("line")).first()[0]
    return actions if cut is None else actions.where(F.col("line") < cut)


def status(actions: DataFrame) -> DataFrame:
    """Counts of one transaction: actions, documents, set changes, first time."""
    return actions.agg(
        F.count("*").alias("actions"), F.count_distinct(F.when(F.col("action") == "SET", F.col("target"))).alias("documents"),
        F.count_distinct(F.when(F.col("action").isin("SADD", "SREM"), F.col("target"))).alias("collections"), F.min_by("ts", "line").alias("created_at"),
    )


def recover(actions: DataFrame, txn: str = "txn_id") -> DataFrame:
    """(txn, key, action, value): pending shadows of all transactions, from their stored actions."""
    ops = known(actions).where(F.col("action").isin("SET", "DELETE"))
    return ops.groupBy(txn, F.col("target").alias("key")).agg(F.max_by(F.struct("action", "value"), "line").alias("e")).select(txn, "key", "e.action", "e.value")
