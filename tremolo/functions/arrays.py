"""Column helpers for ordered numeric arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lets(values: list[Column], body: Callable[..., Column]) -> Column:
    """let for several values that don't depend on each other."""
    if not values:
        return body()
    return let(values[0], lambda v: lets(values[1:], lambda *rest: body(v, *rest)))


def total(a: Column, f: Callable[[Column], Column] | None = None) -> Column:
    """Sum of f over an array; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (f(x) if f else x))


def positions(n: Column) -> Column:
    """0 to n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def at(a: Column, i: Column) -> Column:
    """Element i, 0 outside."""
    return F.when((i >= 0) & (i < F.size(a)), F.get(a, i)).otherwise(F.lit(0.0))


def peak(a: Column) -> Column:
    """Largest absolute value; 0 for an empty array."""
    return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))


def clean(x: Column, digits: int = 9) -> Column:
    """Rounded, and without negative zero."""
    return F.round(x, digits) + F.lit(0.0)
