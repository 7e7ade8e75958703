"""Shared column expressions over texts; JVM-side only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separator runs of the two word rules (Java spelling).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_SET = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, every other code point as it is.

    ``lower`` may serve where every code point is one byte; elsewhere it would
    also touch letters outside ASCII.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str) -> Column:
    """The maximal runs between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def count_of(text: Column, outside: str) -> Column:
    """How many code points are left when runs of the class ``outside`` go."""
    return F.length(F.regexp_replace(text, outside, ""))


def indices(n: Column) -> Column:
    """0 .. n-1; empty for n = 0, where ``sequence`` would count down."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A plain expression would be put in for each of its uses, and inside a
    lambda be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column, block: int = 32) -> Column:
    """For every place of an array of integers the sum of what stands before it.

    Two levels: sums of blocks, then sums inside a block, so that long arrays
    do not cost the square of their length.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    div = lambda i: F.floor(i / F.lit(block)).cast("int")
    sums = lambda xs: F.transform(indices(div(F.size(xs) + (block - 1))), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
    heads = lambda bs: F.transform(indices(F.size(bs)), lambda b: total(F.slice(bs, F.lit(1), b)))
    at = lambda x, i: F.get(x["h"], div(i)) + total(F.slice(x["l"], div(i) * block + 1, i - div(i) * block))
    return let(
        lengths,
        lambda xs: let(sums(xs), lambda bs: let(F.struct(xs.alias("l"), heads(bs).alias("h")), lambda x: F.transform(indices(F.size(x["l"])), lambda i: at(x, i)))),
    )
