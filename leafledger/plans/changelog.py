"""The change log as a table: entries, text lines, hash chain.

Columns: ``line`` (position), ``ts`` (string), ``pointer`` (8 hex digits), ``action``,
``target``, ``old_key``, ``member``, ``value`` (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("SET", "DELETE", "RENAME", "SADD", "SREM")
ENTRY = "action string, target string, old_key string, member string, value string"
_FIELDS = ("action", "target", "old_key", "member", "value")


def entry(action: str, target: Column, value: Column | None = None, old_key: Column | None = None, member: Column | None = None) -> list[Column]:
    """Columns of one kind of entry."""
    null = F.lit(None).cast("string")
    given = {"action": F.lit(action), "target": target, "old_key": old_key, "member": member, "value": value}
    return [(c if c is not None else null).alias(n) for n, c in given.items()]


def payload() -> Column:
    """JSON of an entry; absent fields are left out."""
    return F.to_json(F.struct(*_FIELDS))


def pointer_of(previous: Column, json: Column) -> Column:
    """First 8 hex digits of the SHA-256 of the previous pointer and the entry."""
    return F.left(F.sha2(F.concat(F.coalesce(previous, F.lit("")), json), 256), F.lit(8))


def format_line(ts: Column, pointer: Column, json: Column) -> Column:
    return F.concat_ws("|", ts, pointer, json)


def parse_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Split ``ts|pointer|json`` lines (only the first two bars count); ``ok`` is false for corrupt ones."""
    part = F.split(F.col(text), r"\|", 3)
    json = F.get(part, F.lit(2))
    e = F.from_json(json, ENTRY, {"mode": "PERMISSIVE"})
    out = lines.withColumns({"ts": F.get(part, F.lit(0)), "pointer": F.get(part, F.lit(1)), "json": json, "_e": e})
    out = out.withColumn("ok", F.coalesce(F.col("_e.action").isNotNull() & F.col("_e.target").isNotNull(), F.lit(False)))
    return out.select(*[c for c in lines.columns if c != text], "ts", "pointer", "json", *[F.col(f"_e.{n}").alias(n) for n in _FIELDS], "ok")


def scan_after(log: DataFrame, line: int) -> DataFrame:
    """Readable entries after a line."""
    return log.where((F.col("line") > line) & F.col("ok"))


def line_count(log: DataFrame) -> DataFrame:
    """Line of the last readable entry, 0 if there is none."""
    return log.agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("line"))), F.lit(0)).alias("line"))


def by_lines(log: DataFrame, lines: int = 1000) -> DataFrame:
    """The log with a column ``segment``: runs of ``lines`` lines, so that no segment grows with the log."""
    return log.withColumn("segment", F.floor(F.col("line") / lines))


def _listed(log: DataFrame, segment: list[str]) -> DataFrame:
    return log.groupBy(*segment).agg(F.array_sort(F.collect_list(F.struct("line", "json"))).alias("l"))


def build_chain(log: DataFrame, segment: list[str]) -> DataFrame:
    """Pointers of every line, chained within segments, which must be bounded (``by_lines``, or a file that was bounded when written).

    What goes through the fold is a string of the 8-digit pointers alone.
    """
    step = lambda acc, x: F.concat(acc, pointer_of(F.right(acc, F.lit(8)), x["json"]))
    chained = _listed(log, segment).withColumn("p", F.aggregate("l", F.lit(""), step))
    rows = F.transform("l", lambda x, i: F.struct(x["line"].alias("line"), F.substr("p", i * 8 + 1, F.lit(8)).alias("pointer"), x["json"].alias("json")))
    return chained.select(*segment, F.inline(rows))


def chain_ends(log: DataFrame, segment: list[str]) -> DataFrame:
    """(segment, lines, last pointer) without keeping the pointers between."""
    return _listed(log, segment).select(*segment, F.size("l").cast("long").alias("lines"), F.aggregate("l", F.lit(""), lambda a, x: pointer_of(a, x["json"])).alias("pointer"))


def verify(log: DataFrame, segment: list[str], chained_segments: bool = False) -> DataFrame:
    """Lines whose stored pointer does not follow from the stored pointer before it.

    Checked within segments; with ``chained_segments``, where segments are one column of
    running numbers, the first line of a segment follows the last line of the one before.
    """
    w = Window.partitionBy(*segment).orderBy("line")
    before = F.lag("pointer").over(w)
    rows = log
    if chained_segments:
        (number,) = segment
        ends = log.groupBy((F.col(number) + 1).alias(number)).agg(F.max_by("pointer", "line").alias("_previous"))
        rows = log.join(ends, number, "left")
        before = F.coalesce(before, F.col("_previous"))
    return rows.withColumn("expected", pointer_of(before, F.col("json"))).where(~F.col("pointer").eqNullSafe(F.col("expected")))


def last_pointer(log: DataFrame, segment: list[str] | None = None) -> DataFrame:
    """Pointer to go on from."""
    return log.where("ok").groupBy(*(segment or [])).agg(F.max_by("pointer", "line").alias("pointer"), F.max("line").alias("line"))
