"""Sharding by histogram sort.

Rows are ordered by a key of 24 bytes: a hash of the text (equal texts stand
together), a hash of the id, and the row's number in the written table (so that
no two keys are equal). Splitters between shards are found by counting: each
round, every partition counts exact bytes between candidate boundaries, the
driver narrows each splitter's bracket, and new candidates refine it until the
bytes below it meet the target within the tolerance. Only then are rows
exchanged, once, to parts that are a fraction of a shard each; a row's slot is
its place in its part plus the rows of the shard's parts before it.

The law is ``bytes``: shards of near equal size. A boundary between two texts is
preferred within ``whole_tolerance`` of a shard; a group of equal texts that is
larger is split inside. What reaches the driver is a row per gap between
candidates, at most ``MAX_PROBES`` each round.

Null texts have no bytes; the size of a row is its text's UTF-8 bytes plus 1.
Repeated rows are rows of their own. Columns that clash with outputs are
replaced. A text of any length is one row, and a shard may be off its size by the
largest text. An empty table gives an empty result. Parts hold about
``part_bytes``; beyond MAX_PARTS of them they grow with the data.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import materialize

KEY_BYTES = 24
GROUP = 1 << 128  # keys of one text hash
TOP = 1 << (8 * KEY_BYTES)
MAX_PROBES, MAX_PARTS = 8192, 1 << 17
PART_BYTES = 16 << 20


def _bytes(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=f"S{KEY_BYTES}")


def _count(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Gap number -> (bytes, rows, smallest key, largest key); gap g holds keys from probe g-1 to below probe g."""
    edges = np.array([p.to_bytes(KEY_BYTES, "big") for p in probes], dtype=f"S{KEY_BYTES}")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(edges) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low: dict[int, bytes] = {}
        high: dict[int, bytes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch.column(0))
            order = np.argsort(keys)
            keys, size = keys[order], batch.column(1).to_numpy()[order]
            gap = np.searchsorted(edges, keys, side="right")
            np.add.at(total, gap, size)
            rows += np.bincount(gap, minlength=n)
            starts = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(gap)], strict=True):
                g, a, b = int(gap[s]), keys[s].ljust(KEY_BYTES, b"\0"), keys[e - 1].ljust(KEY_BYTES, b"\0")
                low[g] = min(low.get(g, a), a)
                high[g] = max(high.get(g, b), b)
        at = sorted(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(total[at], pa.int64()), pa.array(rows[at], pa.int64()), pa.array([low[g] for g in at], pa.binary()), pa.array([high[g] for g in at], pa.binary())],
            names=["gap", "size", "n", "low", "high"],
        )

    found = keyed.select("__key", "__size").mapInArrow(local, "gap int, size long, n long, low binary, high binary")
    found = found.groupBy("gap").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return {r["gap"]: (r["size"], r["n"], int.from_bytes(r["low"], "big"), int.from_bytes(r["high"], "big")) for r in found.collect()}


def _splitters(keyed: DataFrame, total: int, n_parts: int, per_shard: int, tolerance: float, whole_tolerance: float) -> list[int]:
    """n_parts - 1 keys, in order; every ``per_shard``-th of them parts two shards and is held to the tighter tolerance."""
    shard = total * per_shard / n_parts
    target = [total * (k + 1) / n_parts for k in range(n_parts - 1)]
    slack = [(tolerance * shard, whole_tolerance * shard) if (k + 1) % per_shard == 0 else (0.1 * total / n_parts,) * 2 for k in range(n_parts - 1)]
    bracket = [(0, 0, TOP, total)] * (n_parts - 1)
    done: list[int | None] = [None] * (n_parts - 1)
    while any(d is None for d in done):
        probes: set[int] = set()
        active = sorted({bracket[k][0::2] for k, d in enumerate(done) if d is None})
        each = max(3, MAX_PROBES // len(active))
        for lo, hi in active:
            step = max(1, (hi - lo) // each)
            if hi - lo > 2 * GROUP:  # candidates between texts
                step = max(GROUP, step)
                probes.update(p // GROUP * GROUP for p in range(lo + step, hi, step) if p // GROUP * GROUP > lo)
            elif lo // GROUP != (hi - 1) // GROUP:
                probes.add(hi // GROUP * GROUP if hi % GROUP else hi - GROUP)
                probes.add((lo // GROUP + 1) * GROUP)
            else:
                probes.update(range(lo + step, hi, step))
            probes = {p for p in probes if 0 < p < TOP}
        edges = sorted(probes)
        gaps = _count(keyed, edges)
        below = [0]
        for g in range(len(edges) + 1):
            below.append(below[-1] + gaps.get(g, (0, 0, 0, 0))[0])
        cum = below[1:-1]  # bytes below each edge
        for k, d in enumerate(done):
            if d is not None:
                continue
            lo, c_lo, hi, c_hi = bracket[k]
            j = bisect_right(cum, target[k]) - 1
            if j >= 0 and edges[j] > lo:
                lo, c_lo = edges[j], cum[j]
            if j + 1 < len(edges) and edges[j + 1] < hi:
                hi, c_hi = edges[j + 1], cum[j + 1]
            g = gaps.get(bisect_right(edges, lo))
            if g:  # no key stands between the bracket's ends and the gap's first and last key
                first, last = g[2], g[3]
                lo = max(lo, first // GROUP * GROUP) if first // GROUP * GROUP >= lo and first // GROUP != last // GROUP else max(lo, first)
                after = (last // GROUP + 1) * GROUP
                hi = min(hi, after if after <= hi and first // GROUP != last // GROUP else last + 1)
            near, whole = slack[k]
            ends = [(abs(c - target[k]), x) for x, c in ((lo, c_lo), (hi, c_hi)) if 0 < x < TOP]
            good = [(off, x) for off, x in ends if off <= near or off <= whole and x % GROUP == 0]
            if good or hi - lo <= 1:
                done[k] = min(good or ends)[1]
            bracket[k] = (lo, c_lo, hi, c_hi)
    out: list[int] = []
    for d in done:
        out.append(max(d, out[-1]) if out else d)
    return out


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: list[str] | None = None,
    extra: dict[str, Column] | None = None,
    tolerance: float = 0.001,
    whole_tolerance: float = 0.005,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``payload`` columns of the rows (all by default) and ``extra`` ones, with size, shard and slot.

    Rows of a shard stand together and in key order inside its parts, so a
    writer can take ``shard`` as the partition column.
    """
    payload = list(docs.columns) if payload is None else payload
    extra = extra or {}
    payload = [c for c in payload if c not in ("size", "shard", "slot", *extra)]
    text = F.col(text_col)
    keyed = docs.select(
        *payload,
        *(e.alias(c) for c, e in extra.items()),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"),
        F.concat(_bytes(F.xxhash64(text)), _bytes(F.xxhash64(id_col)), _bytes(F.monotonically_increasing_id())).alias("__key"),
    )
    keyed = materialize(keyed, "keyed")
    total = keyed.agg(F.sum("__size")).first()[0] or 0
    per_shard = max(1, min(MAX_PARTS // n_shards, -(-total // (n_shards * part_bytes))))
    n_parts = n_shards * per_shard
    splitters = _splitters(keyed, total, n_parts, per_shard, tolerance, whole_tolerance) if total and n_parts > 1 else []
    rows = _count(keyed, sorted(set(splitters))) if total else {}
    distinct = sorted(set(splitters))
    part_of_gap = [0] + [bisect_right(splitters, s) for s in distinct]
    counts = [0] * n_parts
    for g, r in rows.items():
        counts[part_of_gap[g]] += r[1]
    before = [sum(counts[p // per_shard * per_shard : p]) for p in range(n_parts)]
    edges = np.array([s.to_bytes(KEY_BYTES, "big") for s in splitters], dtype=f"S{KEY_BYTES}")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.searchsorted(edges, _keys(batch.column(batch.schema.get_field_index("__key"))), side="right") if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(np.array(before, np.int64)[part.astype(int)])], names=[*batch.schema.names, "__part", "__before"])

    schema = T.StructType([*keyed.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())])
    dealt = keyed.mapInArrow(deal, schema)
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key"))
    return dealt.select(
        *payload,
        *extra,
        F.col("__size").alias("size"),
        F.floor(F.col("__part") / per_shard).cast("int").alias("shard"),
        (place - 1 + F.col("__before")).cast("long").alias("slot"),
    )
