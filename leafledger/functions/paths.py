"""Paths into documents: access, comparison, pointers, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_by_path(root: Column, path: list[str | int]) -> Column:
    """Nested value, null where any step is missing; the empty path is the root."""
    for step in path:
        root = F.get(root, F.lit(step)) if isinstance(step, int) else root.getField(step)
    return root


def json_path(path: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path)


def get_json(body: Column, path: list[str | int], kind: str = "string") -> Column:
    """Value inside a JSON body."""
    return F.get_json_object(body, json_path(path)).cast(kind)


def path_starts_with(path: Column, prefix: Column) -> Column:
    return F.coalesce((F.size(prefix) == 0) | (F.slice(path, F.lit(1), F.greatest(F.size(prefix), F.lit(1))) == prefix), F.lit(False))


def path_equals(a: Column, b: Column) -> Column:
    return a == b


def pointer(path: Column) -> Column:
    """JSON pointer; the empty path is the empty string."""
    steps = F.transform(path, lambda p: F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
    return F.when(F.size(path) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(steps, "/")))


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of the scalar fields of a schema, depth first."""
    out: list[tuple[str, ...]] = []
    for f in schema.fields:
        out += leaves(f.dataType, (*prefix, f.name)) if isinstance(f.dataType, T.StructType) else [(*prefix, f.name)]
    return out


def _elements(value: Column, names: Column) -> Column:
    return F.transform(value, lambda v, i: F.struct(F.concat(names, F.array(i.cast("string"))).alias("path"), v.cast("string").alias("value")))


def flatten_paths(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One row (key, path array, value string) for each leaf; array elements get their index.

    Null fields are absent, as they are in a document.
    """
    own = T.StructType([f for f in df.schema.fields if f.name != key and (columns is None or f.name in columns)])
    scalar, listed = [], []
    for path in leaves(own):
        kind: T.DataType = own
        for step in path:
            kind = kind[step].dataType
        value, names = get_by_path(F.col(f"`{path[0]}`"), list(path[1:])), F.array(*map(F.lit, path))
        if isinstance(kind, T.ArrayType):
            listed.append(_elements(value, names))
        else:
            scalar.append(F.struct(names.alias("path"), value.cast("string").alias("value")))
    parts = [F.array(*scalar)] if scalar else []
    parts += [F.coalesce(a, F.array().cast("array<struct<path:array<string>,value:string>>")) for a in listed]
    rows = df.select(F.col(key), F.explode(F.concat(*parts)).alias("leaf")).select(key, "leaf.path", "leaf.value")
    return rows.where("value is not null")
