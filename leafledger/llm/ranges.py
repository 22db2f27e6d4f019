"""Deal rows to numbered shards by ascending (key, tie), deterministically.

A shard is a run of the order by (key, tie), null keys first, with about equal bytes.
Bytes are summed for each (key, tie); of these groups a sample, drawn by their hashes
with chances in proportion to their bytes, gives the cuts, so cuts depend on the rows
alone, not on how they are partitioned.  The driver and every task get at most
``POINTS`` or 8 points a shard, whichever is more; all rows are dealt.

Keys may take the whole range of 64-bit integers: they are only compared.  A key that
many rows have is cut between its ties.  A group that is larger than a shard, equal in
key and tie, gets shards of its own, over which its rows are dealt by their places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 16 << 20
MOST_SHARDS = 1 << 18
POINTS = 1 << 16


def ordered(present: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Byte strings whose order is that of (present, key, tie)."""
    out = np.empty((len(key), 17), np.uint8)
    out[:, 0] = present
    for at, part in ((1, key), (9, tie)):
        out[:, at : at + 8] = (np.ascontiguousarray(part, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


@dataclass
class Cuts:
    """``first[i]`` is the first shard of rows from ``begin[i]`` on, ``width[i]`` the number of shards they are dealt over."""

    begin: np.ndarray
    first: np.ndarray
    width: np.ndarray
    shards: int

    def interval(self, present: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.searchsorted(self.begin, ordered(present, key, tie), "right") - 1)


def make_cuts(present: np.ndarray, key: np.ndarray, tie: np.ndarray, size: np.ndarray, shards: int) -> Cuts:
    """Cuts between weighted points, which come in any order."""
    point = ordered(present, key, tie)
    order = np.argsort(point)
    point, size = point[order], size[order].astype(float)
    target = max(1.0, size.sum() / max(1, shards))
    begin, first, width, number, filled = [], [], [], 0, np.inf
    for p, n in zip(point, size.tolist()):
        own = max(1, round(n / target))
        if own > 1:
            number += bool(begin)
            begin.append(p)
            first.append(number)
            width.append(own)
            number, filled = number + own - 1, np.inf
            continue
        if filled + n / 2 > target:
            number += bool(begin)
            begin.append(p)
            first.append(number)
            width.append(1)
            filled = 0.0
        filled += n
    # what stands between a wide group and the next point begins just after the group
    rows = []
    for k, (p, f, w) in enumerate(zip(begin, first, width)):
        rows.append((p, f, w))
        if w > 1:
            after = (int.from_bytes(p.ljust(17, b"\0"), "big") + 1).to_bytes(17, "big")
            if k + 1 == len(begin) or after.rstrip(b"\0") != begin[k + 1]:
                rows.append((after, f + w - 1, 1))
    if not rows:
        rows = [(b"", 0, 1)]
    return Cuts(np.array([r[0] for r in rows], "S17"), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), max(r[1] + r[2] for r in rows))


def find_cuts(groups: DataFrame, shard_bytes: int | None = None) -> Cuts:
    """Cuts for materialised ``groups`` (key, tie, size), which may list a (key, tie) several times.

    Without ``shard_bytes``, ``SHARD_BYTES`` is taken, doubled until there are at most
    ``MOST_SHARDS`` shards.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if shard_bytes is None:
        shard_bytes = SHARD_BYTES
        while total > shard_bytes * MOST_SHARDS:
            shard_bytes *= 2
    shards = max(1, -(-total // shard_bytes))
    unit = max(1, total // max(POINTS, 8 * shards))  # a group of so many bytes is always a point
    summed = groups.groupBy("key", "tie").agg(F.sum("size").alias("size"))
    draw = F.pmod(F.xxhash64(F.lit("cut"), "key", "tie"), F.lit(1 << 40)) * F.lit(unit / (1 << 40))
    points = summed.where(F.col("size") > draw).select(F.col("key").isNotNull().cast("int").alias("present"), F.coalesce("key", F.lit(0)).alias("key"), "tie", F.greatest("size", F.lit(unit)).alias("size")).toArrow()
    return make_cuts(*(points.column(c).to_numpy() for c in ("present", "key", "tie", "size")), shards)


def with_interval(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """``rows`` (with columns key and tie) and ``first`` and ``width`` of their shards; only key and tie go to Python."""
    sent = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def interval(present: pd.Series, key: pd.Series, tie: pd.Series) -> pd.Series:
        c = sent.value
        i = c.interval(present.to_numpy(), key.to_numpy(), tie.to_numpy())
        return pd.Series(c.first[i] << 24 | c.width[i])

    both = interval(F.col("key").isNotNull().cast("int"), F.coalesce("key", F.lit(0)), F.col("tie"))
    return rows.withColumn("first", both).withColumns({"first": F.shiftright("first", 24).cast("int"), "width": F.col("first").bitwiseAND((1 << 24) - 1).cast("int")})


def with_shard(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """``rows`` with columns ``shard`` and ``first`` (the first shard over which its group is dealt)."""
    found = with_interval(rows, cuts)
    shard: Column = F.col("first")
    if (cuts.width > 1).any():
        shard += F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("width")).cast("int")
    return found.withColumn("shard", shard).drop("width")
