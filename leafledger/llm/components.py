"""Connected components by star contraction, on DataFrames.

Edges stay distributed.  Each round first replaces a partition's edges by a spanning
forest (union-find over that partition's rows), then links every neighbour of a vertex
to the smallest one (large star, small star).  Rounds end when nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import lean


class UnionFind:
    """Over the integers 0 .. n - 1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, v: int) -> int:
        up = self.up
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (vertex, smallest vertex of its tree) for the given edges."""
    vertices, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    sets = UnionFind(len(vertices))
    a, b = ends[: len(src)].tolist(), ends[len(src) :].tolist()
    for x, y in zip(a, b):
        sets.join(x, y)
    root = np.array([sets.root(v) for v in range(len(vertices))], np.int64)
    other = np.flatnonzero(root != np.arange(len(vertices)))
    return vertices[other], vertices[root[other]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        src, dst = forest(*(np.concatenate(c) for c in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
        if n >= 1 << 20:  # bounded memory: a partial forest is as good as its edges
            yield out()
            held, n = [], 0
    if held:
        yield out()


def local_forest(edges: DataFrame) -> DataFrame:
    """The same connectivity with fewer edges; columns src > dst."""
    return edges.select("src", "dst").mapInArrow(lean(_contract), "src long, dst long")


def components(edges: DataFrame, rounds: int = 60, contracted: bool = False) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (src, dst) but the smallest of each component.

    ``component`` is the smallest vertex that can be reached.  ``contracted`` edges are forests
    already and are not contracted by another Python worker of the task that makes them.
    """
    if contracted:
        first = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    else:
        first = local_forest(edges)
    now = first.where("src <> dst").distinct().checkpoint()
    state = None
    for _ in range(rounds):
        # now has src > dst.  Large star: the larger neighbours of v go to the smallest neighbour of v, if that is
        # smaller.  Joins are on inverted vertices so that both sides are plain shuffles, which Spark can split: a vertex
        # may have very many neighbours.
        low = now.groupBy("src").agg(F.min("dst").alias("m")).select(F.bitwise_not("src").alias("v"), "m")
        large = now.withColumn("v", F.bitwise_not("dst")).join(low, "v", "left").select("src", F.coalesce("m", "dst").alias("dst"))
        large = local_forest(large).distinct().checkpoint()  # read three times below
        # Small star: v and its smaller neighbours go to the smallest of them.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        tied = low.select(F.bitwise_not("src").alias("v"), "m")
        small = large.withColumn("v", F.bitwise_not("src")).join(tied, "v").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = small.unionByName(low.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct().checkpoint()
        check = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(check) == state:
            return now.select(F.col("src").alias("vertex"), F.col("dst").alias("component"))
        state = tuple(check)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
