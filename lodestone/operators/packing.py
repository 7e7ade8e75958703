"""Context packing, chunk algebra and deduplication."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import scan


def budget_prefix(rows: DataFrame, group: str, order: list[Column], cost: Column, budget: int, keep_first: bool = False) -> DataFrame:
    """The longest prefix of each group whose costs fit the budget; with ``keep_first`` the first row stays in any case."""
    w = Window.partitionBy(group).orderBy(*order)
    out = rows.withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.row_number().over(w))
    fits = F.col("used") <= budget
    return out.filter(fits | (F.col("rank") == 1) if keep_first else fits)


def long_budget_prefix(rows: DataFrame, group: str, position: str, cost: Column, budget: int, keep_first: bool = False) -> DataFrame:
    """``budget_prefix`` for groups of any length, in order of a numeric position: sums run over blocks, so no group is one task."""
    priced = rows.withColumn("__cost", cost.cast("long"))
    out = scan.scan(priced, [group], position, {"used": F.col("__cost"), "rank": F.lit(1).cast("long")}, F.sum)
    fits = F.col("used") <= budget
    return out.filter(fits | (F.col("rank") == 1) if keep_first else fits).drop("__cost")


def windows(text: Column, size: int = 350, stride: int = 300) -> Column:
    """Overlapping runs of words; the last one ends with the text."""
    words = F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - (size - stride) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def merge_intervals(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, start, end, n: overlapping or adjacent whole-number intervals become one."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col(start) > reach + 1).cast("int"), F.lit(1)))
    numbered = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("island")


def first_of_equal(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with one key the first by ``order``; rows with an empty key go."""
    keyed = rows.withColumn("__key", key).filter(F.coalesce(F.col("__key"), F.lit("")) != "")
    least = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return keyed.join(least, "__key").filter(F.col(order) == F.col("__first")).drop("__key", "__first")


def dense_ids(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds chunk_id, from 0 in each group, in order of a number; counted over blocks, so no group is one task."""
    return scan.running_number(rows, [group], order, "chunk_id", F.lit(1)).withColumn("chunk_id", F.col("chunk_id") - 1)


def multiset_digest(rows: DataFrame, group: str, content: Column) -> DataFrame:
    """group, n, digest: equal for equal bags of contents, in whatever order.

    The digest is the SHA-256 of all distinct contents' SHA-256 with their counts, in
    order. Equal contents are counted first; a group's hashes are sorted on disk
    where need be and run through the digest one after another, so no group stands in one
    row or in memory. Null contents count in n alone.
    """
    counts = rows.select(F.col(group).alias("g"), F.sha2(content, 256).alias("h")).groupBy("g", "h").agg(F.count("*").alias("c"))
    kind = dict(counts.dtypes)["g"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, digest, some, out, type_ = None, 0, None, False, [], None
        for batch in batches:
            type_ = batch.schema.field("g").type
            for g, h, c in zip(*(batch.column(x).to_pylist() for x in ("g", "h", "c")), strict=True):
                if digest is None or g != key:
                    if digest is not None:
                        out.append((key, n, digest.hexdigest() if some else None))
                    key, n, digest, some = g, 0, hashlib.sha256(), False
                n += c
                if h is not None:
                    digest.update(f"{',' if some else ''}{h}:{c}".encode())
                    some = True
        if digest is not None:
            out.append((key, n, digest.hexdigest() if some else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], type_), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["g", "n", "digest"])

    folded = counts.repartition("g").sortWithinPartitions("g", "h").mapInArrow(fold, f"g {kind}, n long, digest string")
    return folded.withColumnRenamed("g", group)


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows with one key the last; combined before the exchange, so a hot key costs one row a task."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")
