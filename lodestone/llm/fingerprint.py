"""Document fingerprints by Order MinHash.

A text's k-mers are its runs of ``K`` UTF-8 bytes, numbered by occurrence. Each
of ``SKETCHES`` permutations selects the ``PICKED`` smallest, which keep their
order in the text and are hashed as a tuple: the likeness of two fingerprints,
the share of equal tuples, falls with edits and with changes of order. Every
k-mer of a text takes part, long texts in blocks of ``BLOCK``.

A text shorter than ``K`` bytes is one k-mer, which its length tells from longer
ones; an empty or null text has a fingerprint of its own, equal only to itself.
Repeated rows have equal fingerprints. Rows with one id stand in the order of
their texts' hashes, null ids before all others. ``fingerprint`` keeps all other
columns, replacing one of its own name; ``neighbour_fingerprints`` returns its
own columns only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import bound_batches

K, SKETCHES, PICKED, BLOCK = 8, 32, 2, 1024
BUCKET_CHARS, MAX_BUCKETS = 8 << 20, 16384

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SKETCHES, dtype=np.uint64)
_M1, _M2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(30)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _numbered(h: np.ndarray) -> np.ndarray:
    """The hash of each k-mer together with the number of equal ones before it in the text."""
    n = len(h)
    bits = np.uint64(n.bit_length())
    if n < 1 << 16:  # place in the low bits: one plain sort instead of a stable argsort, and 48 bits or more to compare
        low = (np.uint64(1) << bits) - np.uint64(1)
        s = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        at, s = (s & low).astype(np.int64), s >> bits
    else:
        at = np.argsort(h, kind="stable")
        s = h[at]
    again = np.flatnonzero(s[1:] == s[:-1]) + 1
    if not len(again):
        return _mix(h)
    first = np.ones(n, bool)
    first[again] = False
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    number = np.zeros(n, np.uint64)
    number[at[again]] = (again - start[again]).astype(np.uint64)
    return _mix(h + number * _GOLD)


def _smallest(h: np.ndarray) -> np.ndarray:
    """For each permutation the places of its PICKED smallest, (SKETCHES, PICKED) or fewer columns, in text order."""
    rows = np.arange(SKETCHES)[:, None]
    best = np.zeros((SKETCHES, 0), np.int64)
    least = np.zeros((SKETCHES, 0), np.uint64)
    for begin in range(0, len(h), BLOCK):
        order = h[begin : begin + BLOCK] * _FACTORS[:, None] + _TERMS[:, None]
        for _ in range(min(PICKED, order.shape[1])):
            at = order.argmin(axis=1)[:, None]
            best, least = np.c_[best, at + begin], np.c_[least, order[rows, at]]
            order[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        keep = least.argsort(axis=1, kind="stable")[:, :PICKED]
        best, least = best[rows, keep], least[rows, keep]
    return np.sort(best, axis=1)


def sketch(text: str | None) -> np.ndarray:
    """SKETCHES tuples, hashed to 16 bits."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(SKETCHES, np.uint16)
    short = max(0, K - len(data))
    data = data.ljust(K, b"\0")
    n = len(data) - K + 1
    raw = np.empty(n, np.uint64)
    for off in range(min(K, n)):
        part = raw[off::K]
        part[:] = np.frombuffer(data, "<u8", len(part), off)
    with np.errstate(over="ignore"):
        h = _numbered(_mix(raw + _GOLD * np.uint64(1 + short)))
        out = np.zeros(SKETCHES, np.uint64)
        for at in _smallest(h).T:
            out = _mix(out * _M1 + h[at])
    return (out >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def written(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SKETCHES


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (hex) to every row."""
    spare = [c for c in docs.columns if c != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([written(sketch(t)) for t in texts], pa.string())], names=[*batch.schema.names, "fingerprint"])

    schema = docs.select(*spare).schema.add("fingerprint", "string")
    return docs.select(*spare).mapInArrow(run, schema)


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row, in order of id (ties by text hash, nulls first): its fingerprint, that of its edited text, and both likenesses.

    Rows go, once, to buckets of neighbouring ids. Into each bucket also goes
    the first row of the following one (into the last, the first of all), so
    that every row meets its successor in a stream over a sorted bucket. The
    driver gets cuts between ids, at most MAX_BUCKETS.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    stats = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_buckets = max(1, min(MAX_BUCKETS, stats["n"] or 1, -(-(stats["chars"] or 0) // BUCKET_CHARS)))
    cuts: list[int] = []
    if n_buckets > 1:
        shares = [(k + 1) / n_buckets for k in range(n_buckets - 1)]
        cuts = sorted(set(rows.agg(F.percentile_approx("id", shares, 20 * n_buckets)).first()[0] or []))
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids, missing):  # null ids first
        return pd.Series(np.where(missing.to_numpy(), 0, np.searchsorted(edges, ids.to_numpy(), side="right")).astype(np.int32))

    # ids with nulls would come to the worker as floats, which do not hold every long
    key = (F.coalesce("id", F.lit(0)), F.col("id").isNull())
    own = bucket(*key) if cuts else F.lit(0)
    firsts = sorted((r["b"], r["none"], r["first"]) for r in rows.select("id", own.alias("b")).groupBy("b").agg(F.max(F.col("id").isNull()).alias("none"), F.min("id").alias("first")).select("b", "none", F.when(F.col("none"), F.lit(0)).otherwise(F.col("first")).alias("first")).collect())
    follows = {firsts[(k + 1) % len(firsts)][1:]: firsts[k][0] for k in range(len(firsts))}
    to = F.lit(None).cast("int")
    if follows:
        lookup = docs.sparkSession.sparkContext.broadcast(follows)

        @F.pandas_udf("int")
        def guard_of(ids, missing):
            return pd.Series([lookup.value.get((m, i)) for i, m in zip(ids.tolist(), missing.tolist(), strict=True)], dtype="Int32")

        to = guard_of(*key)
    placed = rows.withColumn("own", own).withColumn("guard", to)
    copies = F.array(F.struct(F.col("own").alias("b"), F.lit(0).alias("g")), F.struct(F.col("guard").alias("b"), F.lit(1).alias("g")))
    dealt = placed.select("id", "text", F.explode(F.filter(copies, lambda c: c["b"].isNotNull())).alias("c")).select("id", "text", F.col("c.b").alias("b"), F.col("c.g").alias("g"))
    dealt = dealt.repartition(max(n_buckets, 1), "b").sortWithinPartitions("b", "g", F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        guarded = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                piece = batch.slice(at, 256)
                for row_id, text, b, g in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if g and guarded == b:
                        continue  # only the first of equal ids follows
                    mine = sketch(text)
                    if held is not None:
                        out.append(_pair(held, text, mine))
                    held = None if g else (row_id, text, mine)
                    guarded = b if g else None
                yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    return dealt.mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("doc_id", id_col)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _pair(held: tuple, following: str, theirs: np.ndarray) -> dict:
    row_id, text, mine = held
    tail = len(text) // 4
    edited = text[: len(text) - tail] + following[:tail]
    other = sketch(edited)
    return {
        "doc_id": row_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": written(mine),
        "edited_fingerprint": written(other),
        "near_edited": likeness(mine, other),
        "near_next": likeness(mine, theirs),
    }
