"""Slices of Arrow batches that are bounded by rows and by bytes of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 2048, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """At most ``rows`` rows and, but for single rows, ``size`` bytes of the column ``text``."""
    for batch in batches:
        lengths = np.array(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size, side="right")))
            yield batch.slice(at, n)
            at += n


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(text))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
