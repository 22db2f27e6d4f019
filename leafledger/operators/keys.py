"""Ids that are made of integer key columns.

A column of ids ``CODE_<integer>`` carries in its metadata the code and the column it was
made of, with that column's expression id.  As long as the column still stands beside it
unchanged, an id can be looked up and joined by the integer, which reaches the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = re.compile(r"0|-?[1-9][0-9]{0,18}")


def _expression_id(df: DataFrame, column: str) -> str | None:
    """Catalyst's id of a column; None if there is no such single column or no plan to ask."""
    plan = getattr(df, "_jdf", None)
    if plan is None or df.columns.count(column) != 1:
        return None
    number = plan.queryExecution().analyzed().output().apply(df.columns.index(column)).exprId()
    return f"{number.id()} {number.jvmId().toString()}"


def made_from(df: DataFrame, code: str, column: str) -> dict:
    """Metadata for a column of ids that is made of an integer column of ``df``."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        return {}
    number = _expression_id(df, column)
    return {} if number is None else {"code": code, "column": column, "expression": number}


def key_column(df: DataFrame, ids: str, code: str | None = None) -> tuple[str, Column] | None:
    """(code, integer column) that a column of ids is made of, if that column is still there as it was."""
    if df.columns.count(ids) != 1:
        return None
    at = df.schema[ids].metadata
    if "column" not in at or (code is not None and at["code"] != code) or _expression_id(df, at["column"]) != at["expression"]:
        return None
    return at["code"], df[f"`{at['column']}`"]


def is_id(df: DataFrame, ids: str, wanted: list[str]) -> Column:
    """Condition that a column of ids holds one of the wanted ids."""
    made = key_column(df, ids)
    if made is None:
        return df[f"`{ids}`"].isin(sorted(set(wanted)))
    code, column = made
    parts = {w.removeprefix(f"{code}_") for w in wanted if w.startswith(f"{code}_")}
    numbers = sorted(int(p) for p in parts if _INTEGER.fullmatch(p))
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(df.schema[df.schema[ids].metadata["column"]].dataType), 63)
    numbers = [n for n in numbers if -(1 << bits) <= n < 1 << bits]
    return column.isin(numbers) if len(numbers) != 1 else column == F.lit(numbers[0])


def same(df: DataFrame, field: str, other: DataFrame, key: str) -> tuple[Column, Column]:
    """The columns to compare in a join of ``df`` and ``other`` by id: integers if both are made of them."""
    mine = key_column(df, field)
    theirs = key_column(other, key, mine[0]) if mine else None
    return (mine[1], theirs[1]) if theirs else (df[f"`{field}`"], other[f"`{key}`"])
