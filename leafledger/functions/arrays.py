"""Array methods of documents, as higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def find(a: Column, test: Fn) -> Column:
    """First element that passes, else null."""
    return F.get(F.filter(a, test), F.lit(0))


def find_index(a: Column, test: Fn) -> Column:
    """Index of the first element that passes, else -1."""
    return (F.array_position(F.transform(a, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)) - 1).cast("int")


def index_of(a: Column, value) -> Column:
    return (F.array_position(a, F.lit(value)) - 1).cast("int")


def reduce_right(a: Column, start: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.reverse(a), start, fn)


def flat_map(a: Column, fn: Fn) -> Column:
    return F.flatten(F.transform(a, fn))


def push(a: Column, *values) -> Column:
    return F.concat(a, F.array(*map(F.lit, values)))


def unshift(a: Column, *values) -> Column:
    return F.concat(F.array(*map(F.lit, values)), a)


def pop(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def shift(a: Column) -> Column:
    return F.filter(a, lambda _, i: i > 0)


def splice(a: Column, start: int, count: int, *values) -> Column:
    """Remove ``count`` elements from ``start`` (from 0) and put ``values`` there."""
    head, tail = F.filter(a, lambda _, i: i < start), F.filter(a, lambda _, i: i >= start + count)
    return F.concat(head, F.array(*map(F.lit, values)), tail) if values else F.concat(head, tail)


def set_at(a: Column, index: int, value) -> Column:
    return F.transform(a, lambda x, i: F.when(i == index, F.lit(value)).otherwise(x))


def remove_at(a: Column, index: int) -> Column:
    return F.filter(a, lambda _, i: i != index)
