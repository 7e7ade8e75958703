"""Vector codes: product quantisation in whole numbers, by segment-mean lower bounds.

Components become ``floor(SCALE * x)``; a vector is cut into equal parts, and each
part position has a codebook, fitted by rounds of assignment and means. All
distances, sums and floors are integers, so the result does not depend on how
rows are partitioned.

The nearest entry of a part is found without most of the distances. A part and
an entry are cut into blocks; with block sums S and residuals r (what is left
after taking each block's mean away), the squared distance is at least
``sum((S_v - S_e)**2 / length) + (|r_v| - |r_e|)**2``. One block gives a bound
for every entry; the entries whose bound is no larger than a distance already
known go on to two blocks, then four, and so on. A slack beyond the rounding of
floats keeps the filter conservative. What survives gets its exact
distance; ties go to the lower index.

Rows whose vector is null, or holds a null or non-finite component, are dropped.
Vectors must have one length, a multiple of the number of parts, and components
whose squared distances fit a long; anything else raises ValueError. Null ids
come after all others, and equal ids in order of their vectors, when the first entries are
chosen; repeated rows are rows of their own. With fewer vectors than entries the codebooks are as short as the
table. Columns beyond id, vector and label are not read. An empty
table, or one without kept rows, gives an empty result.

The driver gets the first ``ENTRIES`` vectors and, each round, one sum for every
codebook entry: as many numbers as the codebooks hold, at any size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestone.llm.store import bound_batches, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Pairs of vectors and entries that a task bounds at once, and those that it measures at once.
HELD, MEASURED = 1 << 20, 1 << 16


class Bounds:
    """What the lower bound of a set of vectors needs, by number of blocks: block sums over the root of their lengths, residual norms; and the whole norms."""

    def __init__(self, x: np.ndarray) -> None:
        width = x.shape[1]
        squares = (x.astype(np.float64) ** 2).sum(axis=1)
        self.norm = np.sqrt(squares)
        self.levels = []
        blocks = 1
        while blocks <= max(1, width // 2):
            edges = np.arange(blocks) * width // blocks
            lengths = np.diff(np.r_[edges, width])
            sums = np.add.reduceat(x, edges, axis=1) / np.sqrt(lengths)
            self.levels.append((sums, np.sqrt(np.maximum(squares - (sums**2).sum(axis=1), 0))))
            blocks *= 2


def _bound(v: Bounds, e: Bounds, level: int) -> np.ndarray:
    """Lower bounds for every vector and entry. Block means are compared by one product; the slack covers what that loses."""
    (s, r), (t, q) = v.levels[level], e.levels[level]
    out = np.abs(r[:, None] - q[None, :])
    out -= 1e-6 * (v.norm[:, None] + e.norm[None, :])
    np.maximum(out, 0, out=out)
    out *= out
    out += ((s**2).sum(axis=1) - 1e-9 * v.norm**2 - 0.5)[:, None]
    out += ((t**2).sum(axis=1) - 1e-9 * e.norm**2)[None, :]
    out -= (2 * s) @ t.T
    return out


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry, its squared distance, and how many exact distances that took."""
    index, distance, exact = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), 0
    if not v.shape[1]:
        return index, distance, exact
    entries = Bounds(book)

    def apart(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        for at in range(0, len(i), MEASURED):
            gap = part[i[at : at + MEASURED]] - book[j[at : at + MEASURED]]
            out[at : at + MEASURED] = np.einsum("ij,ij->i", gap, gap)
        return out

    step = max(1, HELD // len(book))
    for at in range(0, len(v), step):
        part = v[at : at + step]
        mine, rows = Bounds(part), np.arange(len(part))
        alive, known = np.ones((len(part), len(book)), bool), None
        for level in range(len(mine.levels)):
            bound = _bound(mine, entries, level)
            if known is not None:
                alive &= bound <= known[:, None]
            hope = np.where(alive, bound, np.inf).argmin(axis=1)
            found = apart(part, rows, hope)
            known = found if known is None else np.minimum(known, found)
            alive &= bound <= known[:, None]
            exact += len(part)
        i, j = np.nonzero(alive)
        d = apart(part, i, j)
        exact += len(d)
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])  # the entry that gave the known distance is alive in every row
        least = np.minimum.reduceat(d, starts)
        hit = np.flatnonzero(d == least[i])
        first = hit[np.r_[True, i[hit][1:] != i[hit][:-1]]]
        index[at : at + step], distance[at : at + step] = j[first], least
    return index, distance, exact


def whole(x: Column, scale: int = SCALE) -> Column:
    """A vector in whole numbers; null for one that is dropped."""
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(batch.num_rows, width)


def _sums(table: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and the sums of the parts' components, of every entry that has any."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = _vectors(batch, parts * width)
            for p in range(parts):
                mine = v[:, p * width : (p + 1) * width]
                index = nearest(mine, books[p])[0]
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, mine)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    found = table.select("v").mapInArrow(run, "part long, entry long, n long, s array<long>")
    total = F.array(*(F.sum(F.get("s", F.lit(k))) for k in range(width))).cast("array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("s"))


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """table: id, v (of one length) -> the codebooks, (parts, entries, width)."""
    first = [r["v"] for r in table.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, len(first[0]) // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(table, books).collect():
            books[r["part"], r["entry"]] = np.floor_divide(np.array(r["s"], np.int64), r["n"])
    return books


def encode(table: DataFrame, books: np.ndarray) -> DataFrame:
    """Replaces ``v`` by ``code`` (an index for each part) and ``error`` (squared distances, summed over parts)."""
    parts, _, width = books.shape
    kept = [c for c in table.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch, parts * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            code, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
            codes = pa.array(list(code.astype(np.int32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), codes, pa.array(error)], names=[*kept, "code", "error"])

    return table.mapInArrow(run, table.select(*kept).schema.add("code", ArrayType(IntegerType())).add("error", "long"))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """The coded rows (id, label, code, error, label_error: the error summed over equal labels) and the codebooks."""
    bound_batches(vectors.sparkSession)
    table = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(F.col(vec_col), scale).alias("v")).filter("v is not null")
    table = materialize(table, "vectors")
    seen = table.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -c)))).alias("large")).first()
    width = seen["least"] or 0
    if seen["n"] and (width != seen["most"] or width % parts):
        raise ValueError(f"vectors of {seen['least']} to {seen['most']} components can't be cut into {parts} equal parts")
    if width * (2 * (seen["large"] or 0)) ** 2 >= 1 << 63:
        raise ValueError("squared distances would not fit a long")
    books = train(table, parts, entries, rounds) if seen["n"] else np.zeros((parts, 0, 0), np.int64)
    coded = materialize(encode(table, books), "coded")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books
