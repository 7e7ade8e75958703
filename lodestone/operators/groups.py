"""Many small groups a batch: rows sorted by group arrive as Arrow batches, and whole groups are worked off together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or one larger group; none parts a group. Rows arrive sorted by ``key``."""
    held, n, full = [], 0, rows
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < full:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        at = int(starts(whole.column(key))[-1])
        if at:
            yield whole.slice(0, at)
        held = whole.slice(at).to_batches()
        n = len(whole) - at
        full = max(rows, 2 * n)  # a group that goes on is not put together anew with each batch
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(*columns: pa.Array | pa.ChunkedArray) -> tuple[list[np.ndarray], int]:
    """Numbers for values, the same in all columns (-1 for null), and how many there are."""
    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    coded = pa.concat_arrays(flat).dictionary_encode()
    found = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(c) for c in flat])[:-1]), len(coded.dictionary)


def starts(column: pa.ChunkedArray) -> np.ndarray:
    """Where each run of equal values begins."""
    own = codes(column)[0][0]
    return np.flatnonzero(np.r_[True, own[1:] != own[:-1]])


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists one after another, and each list's length."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(whole), pc.fill_null(pc.list_value_length(whole), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def met(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with asked[i] == held[j]."""
    order = np.argsort(held, kind="stable")
    ranked = held[order]
    lo, hi = np.searchsorted(ranked, asked), np.searchsorted(ranked, asked, "right")
    many = hi - lo
    i = np.repeat(np.arange(len(asked)), many)
    ends = np.cumsum(many)
    return i, order[np.arange(len(i)) + np.repeat(lo - ends + many, many)]
