"""References between documents: ids become documents by left joins, whose side Catalyst picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import kept
from .keys import same
from .select import ID


def populate(df: DataFrame, field: str, other: DataFrame, key: str = ID) -> DataFrame:
    """Replace an id by the document it names; a dangling or null id gives null."""
    if field not in df.columns:
        raise KeyError(f"no reference field {field!r}")
    # a null id joins nothing; a table of ids with repetitions would multiply rows
    mine, theirs = same(df, field, other, key)
    side = other.select(theirs.alias("_ref"), F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias("_doc"))
    joined = df.join(side, mine == side["_ref"], "left")
    return joined.select(*[F.col("_doc").alias(c) if c == field else df[f"`{c}`"] for c in df.columns])


def populate_all(df: DataFrame, fields: dict[str, DataFrame], key: str = ID) -> DataFrame:
    """Several reference fields; each step keeps what earlier ones did."""
    for field, other in fields.items():
        df = populate(df, field, other, key)
    return df


def populate_array(df: DataFrame, field: str, other: DataFrame, row_key: str = ID, key: str = ID, fields: list[str] | None = None) -> DataFrame:
    """An array of ids becomes an array of documents: order and repetitions stay, dangling ids are null.

    Only the ``fields`` of the documents (all by default) are read and moved.
    """
    side = other.select(F.col(f"`{key}`").alias("_ref"), F.struct(*[F.col(f"`{c}`") for c in fields or other.columns]).alias("_doc"))
    slots = df.select(F.col(f"`{row_key}`").alias("_row"), F.posexplode(F.col(f"`{field}`")).alias("_pos", "_want"))
    found = slots.join(side, slots["_want"] == side["_ref"], "left")
    lists = found.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_doc"))), lambda x: x["_doc"]).alias("_docs"))
    joined = df.join(lists, df[f"`{row_key}`"] == lists["_row"], "left")
    empty = F.when(F.col(f"`{field}`").isNotNull(), F.array().cast(lists.schema["_docs"].dataType))
    return joined.select(*[F.coalesce("_docs", empty).alias(c) if c == field else df[f"`{c}`"] for c in df.columns])


def collapse(value: Column, kind: T.DataType) -> Column:
    """Nested documents become their ids, in structs and arrays."""
    if isinstance(kind, T.StructType):
        if ID in kind.names:
            return value.getField(ID)
        return F.when(value.isNotNull(), F.struct(*[collapse(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: collapse(x, kind.elementType))
    return value


def strip_refs(df: DataFrame) -> DataFrame:
    return df.select(*[collapse(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def children(df: DataFrame, field: str, parents: DataFrame, key: str = ID) -> DataFrame:
    """Rows that refer to one of ``parents``."""
    mine, theirs = same(df, field, parents, key)
    p = parents.select(theirs.alias("_parent"))
    return df.join(p, mine == p["_parent"], "left_semi")


def cascade(parents: DataFrame, df: DataFrame, field: str, gone: DataFrame, key: str = ID) -> tuple[DataFrame, DataFrame]:
    """(parents, children) that stay when ``gone`` (ids in its first column) and what refers to it are deleted."""
    g = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
    return parents.join(g, parents[f"`{key}`"] == g["_gone"], "left_anti"), df.join(g, df[f"`{field}`"] == g["_gone"], "left_anti")


def find_paths(edges: list[DataFrame]) -> DataFrame:
    """Fixed-length traversal: join (src, dst) edge tables end to end; columns v0, v1, ..."""
    out = edges[0].select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    for i, e in enumerate(edges[1:], 1):
        out = out.join(e.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{i + 1}")), f"v{i}")
    return out


def walk(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(vertex, hops) reached from ``start`` by breadth-first frontier joins, shortest first; within ``depth`` hops if that is given."""
    seen = start.select(F.col(start.columns[0]).alias("vertex"), F.lit(0).alias("hops")).distinct()
    frontier, hop = seen, 0
    while depth is None or hop < depth:
        hop += 1
        step = frontier.join(edges, frontier["vertex"] == edges["src"]).select(F.col("dst").alias("vertex")).distinct()
        frontier = kept(edges.sparkSession, step.join(seen, "vertex", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
