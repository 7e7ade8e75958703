"""Resamples drawn by a hash: MD5 of many short messages at once, in vectors.

A draw's hash is fixed by the query, so each of them has to be computed. Messages
``resample:draw`` have up to 15 bytes, so all lie in one MD5 block of which four words are not
fixed, and of the digest only the first word is needed: 61 of 64 steps, on numpy vectors that stay in the cache.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Draws of one task, draws hashed at once, and the values that one row of the broadcast table holds.
DRAWS, AT_ONCE, HELD = 1 << 24, 1 << 14, 1 << 16
SUMS = "b long, total double, n long"

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_heads(words: list[np.ndarray], size: int) -> np.ndarray:
    """The first four bytes (as a big-endian number) of the MD5 of messages of ``size`` bytes; words: those of the padded block that are not zero, but for the length."""
    u = np.uint32
    a, b, c, d = (np.full(len(words[0]), v, u) for v in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the last three steps do not touch the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if g < len(words):
            f += words[g]
        f += u((_SINES[i] + (8 * size if g == 14 else 0)) & 0xFFFFFFFF)
        np.left_shift(f, u(_TURNS[i]), out=turned)
        f >>= u(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += u(_START[0])
    return b.byteswap()


def _said(numbers: np.ndarray, digits: int) -> np.ndarray:
    """Numbers of so many digits (at most 8) in decimal, the first digit in the lowest byte."""
    out, left = np.zeros(len(numbers), np.uint64), numbers.astype(np.uint64)
    for _ in range(digits):
        rest = left // np.uint64(10)
        out = (out << np.uint64(8)) | (left - rest * np.uint64(10) + np.uint64(48))
        left = rest
    return out


def _of_digits(lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
    """Parts of lo .. hi - 1 with equal numbers of digits, as (digits, lo, hi)."""
    while lo < hi:
        digits = len(str(lo))
        yield digits, lo, min(hi, 10**digits)
        lo = min(hi, 10**digits)


def resample_sums(values: np.ndarray, lo: int, hi: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """For resamples lo .. hi - 1 (below 10,000) the sum of the values drawn and how many of them are known (not NaN)."""
    n = len(values)
    known = ~np.isnan(values)
    if known.all():
        known = None
    else:
        values = np.where(known, values, 0.0)
    if np.abs(values).max() < 128 and (values == np.floor(values)).all():
        values = values.astype(np.int8)  # an eighth of the memory that draws jump about in
    total, count = np.zeros(hi - lo), np.full(hi - lo, 0 if known is not None else n, np.int64)
    for digits, i_lo, i_hi in _of_digits(0, n):
        for at in range(i_lo, i_hi, at_once):
            draws = _said(np.arange(at, min(i_hi, at + at_once)), digits)
            together = max(1, at_once // len(draws))
            for b_digits, b_lo, b_hi in _of_digits(lo, hi):
                head = b_digits + 1
                low = draws << np.uint64(8 * head)
                # the digits that do not fit the first eight bytes, and the bit that closes a message
                high, end = draws >> np.uint64(64 - 8 * head), head + digits
                if end < 8:
                    low = low | np.uint64(0x80 << (8 * end))
                else:
                    high = high | np.uint64(0x80 << (8 * (end - 8)))
                for b in range(b_lo, b_hi, together):
                    bs = np.arange(b, min(b_hi, b + together))
                    prefix = _said(bs, b_digits) | np.uint64(ord(":") << (8 * b_digits))
                    first = (prefix[:, None] | low).ravel()
                    words = [first.astype(np.uint32), (first >> np.uint64(32)).astype(np.uint32)]
                    if end >= 8:
                        second = np.tile(high, len(bs))
                        words += [second.astype(np.uint32), (second >> np.uint64(32)).astype(np.uint32)]
                    pick = md5_heads(words, end) >> np.uint32(4)
                    pick -= pick // np.uint32(n) * np.uint32(n)
                    own = slice(b - lo, b - lo + len(bs))
                    total[own] += values[pick].reshape(len(bs), -1).sum(1, dtype=np.float64 if values.dtype == np.float64 else np.int64)
                    if known is not None:
                        count[own] += known[pick].reshape(len(bs), -1).sum(1)
    return total, count


def resample_means(x: DataFrame, n: int, resamples: int, value: Column) -> DataFrame:
    """x: i (0 .. n - 1) -> b, m: the mean of n values of x that resample b draws, null if none is known.

    The values are broadcast, 8 bytes each; a task draws whole resamples, so a row a resample is exchanged.
    """
    at = F.col("i")
    held = x.groupBy(F.floor(at / HELD).alias("part")).agg(F.array_sort(F.collect_list(F.struct(at.alias("i"), value.cast("double").alias("v")))).alias("vs"))
    held = held.select("part", F.transform("vs", lambda v: v["v"]).alias("vs"))
    tasks = min(resamples, max(16, resamples * n // DRAWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, task = {}, None
        for batch in batches:
            for k, (part, own) in enumerate(zip(batch["part"].to_pylist(), batch["task"].to_pylist(), strict=True)):
                parts[part], task = batch["vs"][k].values.to_numpy(zero_copy_only=False), own
        if task is None:
            return
        lo, hi = resamples * task // tasks, resamples * (task + 1) // tasks
        total, count = resample_sums(np.concatenate([parts[k] for k in sorted(parts)]), lo, hi)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(total), pa.array(count)], ["b", "total", "n"])

    drawn = x.sparkSession.range(0, tasks, 1, tasks).select(F.col("id").alias("task")).crossJoin(F.broadcast(held))
    return drawn.mapInArrow(run, SUMS).groupBy("b").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("m"))
