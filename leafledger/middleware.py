"""Middleware around the façade's operations: an onion of ``fn(ctx, next)``.

``ctx`` is a dict with operation, collection, args and, on the way back, df.  A function
that does not call ``next`` ends the chain there.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from .errors import ValidationError
from .operators.validate import Rule, first_error

Middleware = Callable[[dict, Callable[[], None]], None]


class Chain:
    def __init__(self) -> None:
        self._all: list[Middleware] = []

    def use(self, fn: Middleware) -> Callable[[], None]:
        """Add a function; the result removes it again."""
        if not callable(fn):
            raise TypeError("middleware must be a function")
        self._all.append(fn)
        return lambda: self.remove(fn)

    def remove(self, fn: Middleware) -> bool:
        if fn in self._all:
            self._all.remove(fn)
            return True
        return False

    def clear(self) -> None:
        self._all.clear()

    def count(self) -> int:
        return len(self._all)

    def run(self, ctx: dict, final: Callable[[dict], None]) -> DataFrame | None:
        fns = list(self._all)

        def step(i: int) -> None:
            if i < len(fns):
                fns[i](ctx, lambda: step(i + 1))
            else:
                final(ctx)

        step(0)
        return ctx.get("df")


def logging(write: Callable[[str], None] = print, prefix: str = "db") -> Middleware:
    """Write each operation and the time its plan took to make."""

    def fn(ctx: dict, next_: Callable[[], None]) -> None:
        began = time.perf_counter()
        next_()
        write(f"{prefix} {ctx['operation']} {ctx['collection']} {(time.perf_counter() - began) * 1000:.1f} ms")

    return fn


def validation(rules: dict[str, dict[str, Rule]]) -> Middleware:
    """Refuse rows that break the rules of their collection (or of ``*``) before they are added, set or updated."""

    def fn(ctx: dict, next_: Callable[[], None]) -> None:
        own = rules.get(ctx["collection"], rules.get("*"))
        if own and ctx.get("rows") is not None:
            df = ctx["rows"]
            bad = df.select(first_error(df.schema, own).alias("error")).where("error is not null").limit(1).collect()
            if bad:
                raise ValidationError(bad[0].error)
        next_()

    return fn


def hooks(before: dict[str, Callable[[dict], None]] | None = None, after: dict[str, Callable[[dict], None]] | None = None) -> Middleware:
    """Callbacks by operation name; those of ``*`` come first."""

    def fn(ctx: dict, next_: Callable[[], None]) -> None:
        for name in ("*", ctx["operation"]):
            if name in (before or {}):
                before[name](ctx)
        next_()
        for name in ("*", ctx["operation"]):
            if name in (after or {}):
                after[name](ctx)

    return fn
