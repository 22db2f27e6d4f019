"""Row validation: a schema becomes one column that holds the first error, or null."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL = r"\S+@\S+\.\S+"
_NUMBERS = (T.NumericType,)
_TYPES: dict[str, Callable[[T.DataType], bool]] = {
    "string": lambda t: isinstance(t, T.StringType), "ref": lambda t: isinstance(t, T.StringType), "email": lambda t: isinstance(t, T.StringType),
    "number": lambda t: isinstance(t, _NUMBERS), "boolean": lambda t: isinstance(t, T.BooleanType), "date": lambda t: isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)),
    "object": lambda t: isinstance(t, (T.StructType, T.MapType)), "array": lambda t: isinstance(t, T.ArrayType),
}


@dataclass
class Rule:
    """One field: type, required, allowed values, value functions, nested rules, array items."""

    type: str
    required: bool = True
    enum: list[Any] | None = None
    get: Callable[[Column], Column] | None = None
    set: Callable[[Column], Column] | None = None
    properties: dict[str, Rule] = field(default_factory=dict)
    items: Rule | None = None


def _error(name: str, rule: Rule, value: Column | None, kind: T.DataType | None) -> list[Column]:
    if value is None or kind is None:
        return [F.lit(f"{name} is required")] if rule.required else []
    out = []
    if rule.required:
        out.append(F.when(value.isNull(), F.lit(f"{name} is required")))
    if rule.type not in _TYPES or not _TYPES[rule.type](kind):
        out.append(F.when(value.isNotNull(), F.lit(f"{name} must be of type {rule.type}")))
        return out
    if rule.type == "email":
        out.append(F.when(~value.rlike(EMAIL), F.lit(f"{name} must be of type email")))
    if rule.enum is not None:
        out.append(F.when(~value.isin(rule.enum), F.lit(f"{name} must be one of {', '.join(map(str, rule.enum))}")))
    if isinstance(kind, T.StructType):
        for n, r in rule.properties.items():
            inner = _error(f"{name}.{n}", r, value.getField(n) if n in kind.names else None, kind[n].dataType if n in kind.names else None)
            out += [F.when(value.isNotNull(), e) for e in inner]
    if rule.items is not None and isinstance(kind, T.ArrayType):
        def bad(x: Column) -> Column:
            return F.coalesce(*(_error(f"{name}[]", rule.items, x, kind.elementType) or [F.lit(None).cast("string")]), F.lit(None).cast("string"))

        out.append(F.get(F.filter(F.transform(value, bad), lambda e: e.isNotNull()), F.lit(0)))
    return out


def first_error(schema: T.StructType, rules: dict[str, Rule]) -> Column:
    """The first error in rule order, null for valid rows."""
    errors: list[Column] = []
    for n, r in rules.items():
        known = n in schema.names
        errors += _error(n, r, F.col(f"`{n}`") if known else None, schema[n].dataType if known else None)
    return F.coalesce(*errors, F.lit(None).cast("string"))


def transformed(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Apply value functions, ``get`` before ``set``."""
    for n, r in rules.items():
        for fn in (r.get, r.set):
            if fn is not None and n in df.columns:
                df = df.withColumn(n, fn(F.col(f"`{n}`")))
    return df


def validate(df: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """``df`` with transformed values and a column ``error``."""
    return transformed(df.withColumn("error", first_error(df.schema, rules)), rules)
