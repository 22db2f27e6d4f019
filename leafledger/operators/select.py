"""Lookups and predicates.  Everything becomes Catalyst expressions before the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidSelector
from ..functions.names import check_id
from . import keys

ID = "$ID"


class Doc:
    """What a predicate function gets: attributes are columns, so it is compiled, not run by row."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Column:
        return self._df[f"`{name}`"]


def _literal_array(values: list, kind: T.ArrayType) -> Column:
    return F.array(*map(F.lit, values)).cast(kind)


def match(schema: T.StructType, query: dict, deep: bool = False, root: Column | None = None) -> Column:
    """Condition that a row matches a query object.

    Partial: every key must match, nested objects recursively, arrays by their first
    elements.  Deep: arrays must be equal.  Comparison is null-safe; a key that the
    schema lacks never matches.
    """
    out = F.lit(True)
    for name, want in query.items():
        if name not in schema.names:
            return F.lit(False)
        kind = schema[name].dataType
        value = F.col(f"`{name}`") if root is None else root.getField(name)
        if isinstance(want, dict):
            if not isinstance(kind, T.StructType):
                return F.lit(False)
            out &= value.isNotNull() & match(kind, want, deep, value)
        elif isinstance(want, (list, tuple)):
            if not isinstance(kind, T.ArrayType):
                return F.lit(False)
            own = value if deep else F.slice(value, 1, max(1, len(want)))
            same = F.lit(True) if not want and not deep else own == _literal_array(list(want), kind)
            out &= value.isNotNull() & F.coalesce(same, F.lit(False))
        else:
            out &= value.eqNullSafe(F.lit(want))
    return out


def where(df: DataFrame, test: Callable | dict | Column | None, deep: bool = False) -> DataFrame:
    """Rows that pass a function of ``Doc``, a query object or a column."""
    if test is None:
        return df
    if isinstance(test, dict):
        return df.where(match(df.schema, test, deep))
    if isinstance(test, Column):
        return df.where(test)
    if callable(test):
        got = test(Doc(df))
        if not isinstance(got, (Column, bool)):
            raise InvalidSelector("a predicate function must return a column")
        return df.where(got if isinstance(got, Column) else F.lit(got))
    raise InvalidSelector(f"cannot select by {type(test).__name__}")


def get_by_id(df: DataFrame, code: str, key: str | dict) -> DataFrame:
    """The row of an id, or of an object with ``$ID`` whose other keys must match too."""
    if isinstance(key, dict):
        if ID not in key:
            raise InvalidSelector("an object selector needs $ID")
        rest = {k: v for k, v in key.items() if k != ID}
        return where(df.where(keys.is_id(df, ID, [check_id(code, key[ID])])), rest or None)
    return df.where(keys.is_id(df, ID, [check_id(code, key)]))


def get_any_type(collections: dict[str, DataFrame], key: str) -> DataFrame | None:
    """The row of an id of any type: the id's code says which of the collections (by code) to look at; None if it is of none of them."""
    code = key.removeprefix("X:").partition("_")[0]
    df = collections.get(code)
    return None if df is None else df.where(keys.is_id(df, ID, [key]))


def get_by_ids(df: DataFrame, code: str, wanted: list[str]) -> DataFrame:
    """A row for each slot of ``wanted``, in order (column ``slot``): repetitions stay, unknown ids are null rows."""
    if not isinstance(wanted, (list, tuple)):
        raise InvalidSelector("a list of ids is needed")
    full = [k if k.startswith(f"{code}_") else f"{code}_{k}" for k in wanted]
    slots = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(full)], "slot int, wanted string")
    own = df.where(keys.is_id(df, ID, full))  # reaches the scan; the join only orders and repeats
    return slots.join(own, slots["wanted"] == own[f"`{ID}`"], "left").orderBy("slot")


def in_set(df: DataFrame, column: str, members: DataFrame, negate: bool = False) -> DataFrame:
    """Rows whose column is (not) in the first column of ``members``."""
    other = members.select(F.col(members.columns[0]).alias("_member")).distinct()
    return df.join(other, df[f"`{column}`"] == other["_member"], "left_anti" if negate else "left_semi")


def first_match(df: DataFrame, test, order: list[Column]) -> DataFrame:
    return where(df, test).orderBy(*order).limit(1)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in a total order."""
    if number < 1 or size < 1:
        raise InvalidSelector("page and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
