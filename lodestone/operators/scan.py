"""Prefix scans within groups that compose across partitions.

Ordered groups (the rows of a document, say) are cut into blocks of positions. A
block's running value comes from a window over the block; what stands before it,
from a window over the blocks' totals, a row each. So the largest task handles
``block`` rows or one row in ``block``, whatever a group's size, where a window
over the group would be one task.

Positions are whole numbers that ascend in a group; gaps only make blocks
smaller, and equal positions are peers in no defined order. A null group is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def scan(rows: DataFrame, group: list[str], position: str, values: dict[str, Column], how=F.max, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds, under each name of ``values``, the aggregate ``how`` of the values up to (or, unless ``inclusive``, before) the row's position.

    ``how`` must be associative and skip nulls, as sum, min and max do; a null
    comes out where nothing came before.
    """
    keys = [*group, "__block"]
    raw = {f"__raw_{k}": v for k, v in values.items()}
    cut = rows.withColumns({"__block": F.floor(F.col(position) / F.lit(block)), **raw})
    inside = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys).agg(*(how(f"__raw_{k}").alias(f"__total_{k}") for k in values))
    before = totals.select(*(F.col(c).alias(f"__at_{c}") for c in keys), *(how(f"__total_{k}").over(earlier).alias(f"__before_{k}") for k in values))
    same = [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in keys]
    out = cut.withColumns({f"__own_{k}": how(f"__raw_{k}").over(inside) for k in values}).join(before, [*same][0] if len(same) == 1 else _all(same), "left")
    both = {k: _joined(F.col(f"__before_{k}"), F.col(f"__own_{k}"), how) for k in values}
    kept = [c for c in rows.columns if c not in values]
    return out.select(*kept, *(v.alias(k) for k, v in both.items()))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _joined(a: Column, b: Column, how) -> Column:
    """The aggregate of two partial results, either of which may be null."""
    if how is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    worse = (a < b) if how is F.max else (a > b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(worse, b).otherwise(a)


def carry_last(rows: DataFrame, group: list[str], position: str, name: str, value: Column, inclusive: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds the last value that is not null, up to or before the row."""
    placed = F.when(value.isNotNull(), F.struct(F.col(position).alias("at"), value.alias("value")))
    out = scan(rows, group, position, {"__carried": placed}, F.max, inclusive, block)
    return out.withColumn(name, F.col("__carried.value")).drop("__carried")


def running_number(rows: DataFrame, group: list[str], position: str, name: str, starts: Column, block: int = BLOCK) -> DataFrame:
    """Adds how many rows up to this one start something."""
    return scan(rows, group, position, {name: starts.cast("long")}, F.sum, True, block).withColumn(name, F.coalesce(name, F.lit(0)))


def heading_paths(items: DataFrame, doc: str = "doc", position: str = "ord", level: str = "level", text: str = "text", levels: int = 8, block: int = BLOCK) -> DataFrame:
    """Adds ``path``: the headings above each item, outermost first; ``level`` is null for items that are no heading.

    A heading closes all open ones of its level and deeper. So the heading open
    at a level is the last one there, if none further out came after it: one
    running maximum a level, which composes, and no stack. A heading's own path
    ends with itself. Levels are 0 to ``levels`` - 1; a deeper one raises.
    """
    deep = F.when(F.col(level) >= levels, F.raise_error(F.lit(f"a heading is deeper than level {levels - 1}")))
    at = lambda k: F.when(F.coalesce(deep, F.col(level)) == k, F.struct(F.col(position).alias("at"), F.col(text).alias("text")))
    seen = scan(items, [doc], position, {f"__level{k}": at(k) for k in range(levels)}, F.max, True, block)
    open_at = []
    for k in range(levels):
        outer = [F.coalesce(F.col(f"__level{j}.at"), F.lit(-1)) for j in range(k)]
        furthest = F.greatest(F.lit(-1), *outer) if outer else F.lit(-1)
        open_at.append(F.when(F.col(f"__level{k}.at") > furthest, F.col(f"__level{k}.text")))
    return seen.withColumn("path", F.array_compact(F.array(*open_at))).drop(*(f"__level{k}" for k in range(levels)))
