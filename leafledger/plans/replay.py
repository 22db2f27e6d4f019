"""State from the log: every fold is a partial aggregate, so a hot key is no hot task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from .changelog import ACTIONS

DOUBLED = 1 << 18


def known(log: DataFrame) -> DataFrame:
    """Entries with an action that exists."""
    return log.where(F.col("action").isin(*ACTIONS))


def _last(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.max_by(F.struct("action", "value", "line"), "line").alias("e"))


def _held(plain: DataFrame, renames: DataFrame) -> DataFrame:
    """(key, e): of the plain entries of keys that were renamed, the last before each rename and the last of all.

    The lines of a key's renames cut its entries into intervals; an aggregate takes the
    last entry of each, so a hot key makes no hot task.
    """
    cuts = renames.groupBy(F.col("old").alias("key")).agg(F.array_sort(F.collect_set("at")).alias("cuts"))
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    # the number of cuts that are not after the line, by binary search
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.coalesce(F.get("cuts", p + s - 1) <= F.col("line"), F.lit(False)), p + s).otherwise(p))
    return plain.join(cuts, "key").groupBy("key", place.alias("part")).agg(F.max_by(F.struct("line", "action", "value"), "line").alias("e")).drop("part")


def _ends(links: DataFrame, spark: SparkSession) -> DataFrame:
    """(id, to) with ``to`` moved to the end of its path, the first node that has no link itself.

    Nodes toss a coin.  Those with heads whose target has tails are set aside, about a
    quarter and never two in a row, and links to them go on to their targets.  Every level
    has three quarters of the links of the one before, so all of them together have four
    times the links, however long paths are.  The last ``DOUBLED`` links are doubled until
    they end; then those that were set aside look up their targets, last level first.
    """
    aside = []
    while links.count() > DOUBLED:
        heads = {n: F.xxhash64(n, F.lit(len(aside))).bitwiseAND(1) == 1 for n in ("id", "to")}
        off = heads["id"] & ~heads["to"]
        aside.append(links.where(off))
        step = aside[-1].select(F.col("id").alias("to"), F.col("to").alias("next"))
        passed = links.where(~off & heads["to"]).join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        links = files.kept(spark, links.where(~off & ~heads["to"]).unionByName(passed))
    more = True
    while more:
        step = links.select(F.col("id").alias("to"), F.col("to").alias("next"))
        j = files.kept(spark, links.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("more")))
        links, more = j.select("id", "to"), not j.where("more").isEmpty()
    if aside:
        folder = files.work_dir(spark)
        links = files.kept(spark, links, folder)
    for off in reversed(aside):
        found = links.select(F.col("id").alias("to"), F.col("to").alias("end"))
        links = files.kept(spark, off.join(found, "to", "left").select("id", F.coalesce("end", "to").alias("to")), folder)
    return links


def _seen(renames: DataFrame, held: DataFrame) -> DataFrame:
    """What every rename (id, old, new, at) finds, if all of them move something: rows (out, id, key, at, state, to, value, alone).

    A rename looks at what happened last to its old key: its row with ``out`` 1 has as
    ``state`` whether a document is there, with its ``value``.  If another rename brought
    one there, state is null and ``to`` that rename, and what holds at the end of the path
    holds for it; ``alone`` is whether nothing else happened to the key before.  Rows with
    ``out`` 0 are of new keys, without those that the next event moves on.
    """
    moved = renames.select(F.col("new").alias("key"), "at", F.lit(0).alias("out"), "id", "old")
    left = renames.select(F.col("old").alias("key"), "at", F.lit(1).alias("out"), "id")
    rows = moved.unionByName(left, allowMissingColumns=True).unionByName(held.select("key", F.col("e.line").alias("at"), "e"), allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy("at")
    before = w.rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "p": F.max(F.when(F.col("id").isNotNull(), F.struct("at", "out", "old", "id"))).over(before), "last": F.max("e").over(before), "n": F.count("*").over(before),
        "moves_on": (F.lead("out").over(w) == 1) & (F.lead("at").over(w) > F.col("at")), "previous": F.lag("id").over(w),
    })
    by_entry = F.col("p").isNull() | F.coalesce(F.col("last.line") >= F.col("p.at"), F.lit(False))
    to = F.when((F.col("out") == 1) & ~by_entry & (F.col("p.out") == 0), F.col("p.id"))
    state = F.when((F.col("out") == 1) & to.isNull(), by_entry & F.coalesce(F.col("last.action") == "SET", F.lit(False)))
    rows = rows.where((F.col("out") == 1) | (F.col("out") == 0) & ~F.coalesce("moves_on", F.lit(False)))
    return rows.select("out", "id", "key", "at", state.alias("state"), to.alias("to"), F.when(state, F.col("last.value")).alias("value"), F.coalesce((to == F.col("previous")) & (F.col("n") == 1), F.lit(False)).alias("alone"))


def last_entries(log: DataFrame, renames: bool = True, deleted: bool = True) -> DataFrame:
    """(key, action, value, line) of the last entry of each key, where a RENAME is a DELETE and a SET.

    A rename gives what its old key holds just before it, nothing if that is absent or
    the new key is the old one.  Chains may have any length: a round resolves whole chains,
    and only a rename in the middle of one that has nothing to move asks for another round.
    Without ``deleted``, keys that a rename wrote and the next one left are missing.
    """
    own = known(log)
    plain = own.where(F.col("action").isin("SET", "DELETE")).select(F.col("target").alias("key"), "line", "action", "value")
    asked = own.where("action = 'RENAME' and old_key <> target").select(F.col("old_key").alias("old"), F.col("target").alias("new"), F.col("line").alias("at"))
    if not renames or asked.isEmpty():
        return _last(plain).select("key", "e.*")
    spark = log.sparkSession
    live = files.kept(spark, asked.select(F.monotonically_increasing_id().alias("id"), "*"))
    held = files.kept(spark, _held(plain, live))
    while True:
        seen = files.kept(spark, _seen(live, held))
        links, idle = seen.where("to is not null").select("id", "to"), seen.where("not state").select("id")
        if links.isEmpty():
            ends = links
            break
        ends = _ends(links, spark)
        # behind one that has nothing to move a rename stays open: what was there before that one counts then
        if idle.isEmpty() or ends.join(idle.select(F.col("id").alias("to")), "to").isEmpty():
            break
        live = files.kept(spark, live.join(idle, "id", "left_anti"))
    left = seen.where("out = 1 and (state or to is not null)")
    left = (left if deleted else left.where("not alone")).select("key", F.col("at").alias("line"), F.lit("DELETE").alias("action"))
    values = seen.where("state").select(F.col("id").alias("to"), "value")
    moved = seen.where("out = 0").select("id", "key", F.col("at").alias("line")).join(ends, "id", "left").withColumn("to", F.coalesce("to", "id")).join(values, "to")
    moved = moved.select("key", "line", F.lit("SET").alias("action"), "value")
    return _last(plain.unionByName(left, allowMissingColumns=True).unionByName(moved)).select("key", "e.*")


def documents(log: DataFrame, renames: bool = True) -> DataFrame:
    """(key, value, line) of the documents that live."""
    return last_entries(log, renames, deleted=False).where("action = 'SET'").select("key", "value", "line")


def sets(log: DataFrame) -> DataFrame:
    """(set_name, member): the last SADD or SREM of each pair counts."""
    ops = known(log).where(F.col("action").isin("SADD", "SREM"))
    last = ops.groupBy(F.col("target").alias("set_name"), "member").agg(F.max_by("action", "line").alias("a"))
    return last.where("a = 'SADD'").select("set_name", "member")


def as_of(log: DataFrame, line: int) -> DataFrame:
    """Documents after a line."""
    return documents(log.where(F.col("line") <= line))


def snapshot_entries(snapshot: DataFrame, line: int) -> DataFrame:
    """A snapshot (key, value) as SET entries at its line."""
    null = F.lit(None).cast("string")
    return snapshot.select(F.lit(line).cast("long").alias("line"), F.lit("SET").alias("action"), F.col("key").alias("target"), null.alias("old_key"), null.alias("member"), "value")


def from_snapshot(snapshot: DataFrame, line: int, log: DataFrame) -> DataFrame:
    """Documents from a snapshot and the log after it."""
    tail = log.where(F.col("line") > line).select("line", "action", "target", "old_key", "member", "value")
    return documents(snapshot_entries(snapshot, line).unionByName(tail))
