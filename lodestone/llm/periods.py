"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

A run is a stretch of words with smallest period q that is at least
``max(LEAST, TIMES * q)`` words long and that no neighbouring word extends
keeping the period. A document may hold many, also within each other.

Names of level k stand for blocks of 2**k words: two places of one document have
the same name exactly if their blocks are equal. A level is made from the one
below by ranking pairs of names; a block that occurs once gets no name, and
neither does any longer block that holds it, so higher levels rank only what
still repeats. No hashes and no suffix sorting take part.

A run of period q matches itself q words further on over at least
``max(LEAST - q, (TIMES - 1) * q)`` places in a row. Every stretch of that length
holds a whole block of about half its length at a multiple of that block's
length, so comparing the names on this grid finds every run: n / q comparisons
for a period, n log n for all of them. From the first grid place of each stretch
the match is extended both ways, by the longest common extension: the levels from
the highest down, each taken at most once. Of equal stretches the smallest
period stays; the larger ones are its multiples.

Documents are named together in slices of about a megabyte, so numpy's calls
serve many texts; a longer text is a slice of its own. A slice takes memory in
proportion to its words times the levels at which something still repeats.

Rows are handled one by one: nothing is exchanged. A null text has no runs and
stays null; empty texts and texts without words have none and collapse to "".
Equal texts give equal results, as ties are decided by places in the text only.
Other columns pass through; existing ``runs`` and ``collapsed`` are replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lodestone.llm.batches import slices, texts_of
from lodestone.llm.store import bound_batches

#: A run's least length, and its least length in periods (two at least: the grid rests on it).
LEAST, TIMES = 24, 3

RUNS = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _renamed(at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Names of the places ``at`` by equal keys; -1 for all other places and for keys that occur once."""
    out = np.full(n, -1, np.int32)
    if len(at):
        order = np.argsort(keys)
        s = keys[order]
        new = np.r_[True, s[1:] != s[:-1]]
        name = np.cumsum(new) - 1
        twice = (np.bincount(name) > 1)[name]
        out[at[order[twice]]] = name[twice]
    return out


def naming(words: np.ndarray, doc: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """The levels of names of a concatenation of documents, up to ``most`` levels or the last at which something repeats."""
    n = len(words)
    levels = [_renamed(np.arange(n), doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, n)]
    while len(levels) < most:
        below, half = levels[-1], 1 << (len(levels) - 1)
        if half >= n:
            break
        # a block over the end of a document has no equal in it, as names of words tell documents apart
        at = np.flatnonzero((below[:-half] >= 0) & (below[half:] >= 0))
        above = _renamed(at, below[at].astype(np.int64) * n + below[at + half], n)
        if not (above >= 0).any():
            break
        levels.append(above)
    return levels


def _extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from places i and j > i on (step 1), or before them (step -1), are equal."""
    got, n = np.zeros(len(i), np.int64), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        a, b = (i + got, j + got) if step > 0 else (i - got - size, j - got - size)
        inside = (b < n) if step > 0 else (a >= 0)
        x = levels[k][np.where(inside, a, 0)]
        got += size * (inside & (x >= 0) & (x == levels[k][np.where(inside, b, 0)]))
    return got


def _stretches(words: np.ndarray, sizes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in the concatenation, length and period of all runs; documents stand by falling size."""
    levels = naming(words, np.repeat(np.arange(len(sizes)), sizes))
    ends, falling = np.cumsum(sizes), -sizes
    found_at, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q in range(1, int(sizes[0]) // times + 1):
        k = ((max(least - q, (times - 1) * q) + 1) // 2).bit_length() - 1
        many = int(np.searchsorted(falling, -max(least, times * q), side="right"))
        if k >= len(levels) or not many:
            if not many or q >= least:
                break  # blocks only grow from here on
            continue
        names, upto = levels[k], int(ends[many - 1])
        here, there = names[: upto - q : 1 << k], names[q : upto : 1 << k]
        hits = np.flatnonzero((here == there) & (here >= 0))
        if len(hits):
            hits = hits[np.r_[True, hits[1:] > hits[:-1] + 1]]  # neighbours on the grid are in one stretch
            found_at.append(hits << k)
            found_q.append(np.full(len(hits), q))
    at, q = np.concatenate(found_at), np.concatenate(found_q)
    before = _extended(levels, at, at + q, -1)
    start, length = at - before, before + _extended(levels, at, at + q, 1) + q
    good = length >= np.maximum(least, times * q)
    start, length, q = start[good], length[good], q[good]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    return start[new], length[new], q[new]


def runs_of(documents: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each list of words its runs, as rows (start, length, period) by start and period."""
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    held = [d for d, ws in enumerate(documents) if len(ws) >= least]
    if not held:
        return out
    number: defaultdict = defaultdict(count().__next__)
    sizes = np.array([len(documents[d]) for d in held])
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(documents[d] for d in held)), np.int64, int(sizes.sum()))
    # the least block that the grid compares must repeat somewhere in a document
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    level = ((shortest + 1) // 2).bit_length() - 1
    doc = np.repeat(np.arange(len(held)), sizes)
    levels = naming(words, doc, level + 1)
    if len(levels) <= level:
        return out
    again = np.unique(doc[levels[level] >= 0])
    again = again[np.argsort(-sizes[again], kind="stable")]
    first = np.cumsum(sizes) - sizes
    start, length, period = _stretches(np.concatenate([words[first[d] : first[d] + sizes[d]] for d in again]), sizes[again], least, times)
    ends = np.cumsum(sizes[again])
    owner = np.searchsorted(ends, start, side="right")
    table = np.stack([start - (ends - sizes[again])[owner], length, period], axis=1)
    table = table[np.lexsort((table[:, 2], table[:, 0], owner))]
    for d, rows in zip(again, np.split(table, np.cumsum(np.bincount(owner, minlength=len(again)))[:-1]), strict=True):
        out[held[d]] = rows
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, carry: list[str] | None = None) -> DataFrame:
    """Adds ``runs``, by start and period in words from 0, and ``collapsed``: the text's words, joined by a space, with each run cut to its first period.

    ``carry`` names the columns to keep; all of them by default.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    bound_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            texts = texts_of(piece, "__text")
            words = [(t or b"").split() for t in texts]
            runs = runs_of(words, least, times)
            joined = [None if t is None else _collapsed(w, r) for t, w, r in zip(texts, words, runs, strict=True)]
            flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
            ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUNS.value_type)))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], spans, pa.array(joined, pa.binary()).cast(pa.string())], names=[*kept, "runs", "collapsed"])

    rows = docs.select(*kept, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, docs.select(*kept).schema.add("runs", RUNS).add("collapsed", "string"))
