"""Word-shingle sets of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("up", _BASE), ("down", inverse)):
            out = np.full(size, b, U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of all texts, in order: the row and a hash of the word, A-Z lowered."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    texts = texts.fill_null("") if texts.null_count else texts
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    first, last = int(at[0]), int(at[-1])
    if first == last:
        return np.zeros(0, np.int64), np.zeros(0, U)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, last - first, first)]
    at = at - first
    letter = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True  # rows start here
    before = np.r_[False, letter[:-1]] & ~cut[:-1]
    after = np.r_[letter[1:], False] & ~cut[1:]
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    up, down = _tables(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    rows = np.searchsorted(at, starts, side="right") - 1
    return rows, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _STEP)


def shingle_sets(texts: pa.Array, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, by row and hash: (row, shingle). A text of fewer words is one shingle; one without words has none."""
    rows, words = _word_hashes(texts)
    with np.errstate(over="ignore"):
        n = len(words) - k + 1
        out_rows, out = np.zeros(0, np.int64), np.zeros(0, U)
        if n > 0:
            h = words[:n].copy()
            for j in range(1, k):
                h = h * _STEP + words[j : j + n]
            whole = rows[:n] == rows[k - 1 :]
            out_rows, out = rows[:n][whole], mix(h[whole])
        counts = np.bincount(rows, minlength=len(texts))
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            begin = np.searchsorted(rows, short)
            h = words[begin]
            for j in range(1, k - 1):
                more = counts[short] > j
                h = np.where(more, h * _STEP + words[np.minimum(begin + j, len(words) - 1)], h)
            out_rows, out = np.r_[out_rows, short], np.r_[out, mix(h + counts[short].astype(U))]
        order = np.lexsort((out, out_rows))
        out_rows, out = out_rows[order], out[order]
        if len(out):
            new = np.r_[True, (out[1:] != out[:-1]) | (out_rows[1:] != out_rows[:-1])]
            out_rows, out = out_rows[new], out[new]
    return out_rows, out
