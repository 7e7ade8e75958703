"""Filters over metadata as callers give them: guards, and the predicate they stand for.

A filter is a dict of key to value, or to ``{"$in": [...]}``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys a caller may filter by, the one operator, and the audience that is open to all.
ALLOWED = frozenset({"doc_type", "doc_id", "section", "category", "year", "source_type", "audience"})
IN, COMPANY = "$in", "company"

Filters = dict[str, object]


def lenient(filters: Filters | None) -> Filters | None:
    """The filter without keys that are not allowed."""
    return {k: v for k, v in filters.items() if k in ALLOWED} if filters else filters


def _operand(key: str, want: object) -> tuple[bool, object]:
    """(membership, values) of one condition; an operator other than $in raises."""
    if not isinstance(want, dict):
        return False, want
    if set(want) != {IN}:
        raise ValueError(f"unsupported filter operator for {key}: {want}")
    return True, list(want[IN])


def strict(filters: Filters | None) -> Filters:
    """The filter itself; raises on an empty one, an unknown key or operator, so that no scope is widened silently."""
    if not filters:
        raise ValueError("scope filters are required")
    if unknown := sorted(set(filters) - ALLOWED):
        raise ValueError(f"unsupported scope filter keys: {unknown}")
    for key, want in filters.items():
        _operand(key, want)
    return dict(filters)


def unit_scopes(unit: str | None) -> tuple[Filters, Filters]:
    """What a unit may read: all external documents, and internal ones of the company and its own."""
    return {"source_type": "external"}, {"source_type": "internal", "audience": {IN: [COMPANY, *([unit] if unit else [])]}}


def predicate(filters: Filters | None, columns: list[str] | None = None) -> Column:
    """The filter as a column, which the scan may push down. A missing value is a value: it equals only null, and a key that ``columns`` lacks is null everywhere."""

    def test(key: str, want: object) -> Column:
        value = F.col(key) if columns is None or key in columns else F.lit(None).cast("string")
        many, wanted = _operand(key, want)
        if not many:
            return value.eqNullSafe(F.lit(wanted))
        some = [w for w in wanted if w is not None]
        hit = F.coalesce(value.isin(some), F.lit(False)) if some else F.lit(False)
        return hit | value.isNull() if None in wanted else hit

    return reduce(lambda a, b: a & b, (test(k, v) for k, v in (filters or {}).items()), F.lit(True))
