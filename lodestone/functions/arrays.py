"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not once for each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0, where ``sequence`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def strings() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def appended(xs: Column, x: Column) -> Column:
    return F.concat(xs, F.array(x))
