"""Byte views of Arrow string batches, without a Python object per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step of a vectorised operator handles; longer batches are cut at rows.
STEP = 4 << 20


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` (null: empty) and the n + 1 row offsets into them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]] if len(every) else every, offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``size`` bytes of text; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = view(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def cuts(inner: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted offsets of the bytes that ``inner`` flags (all bytes but the first have a flag) and of the rows."""
    here = np.zeros(int(rows[-1]) + 1, bool)
    here[1:-1] = inner
    here[rows] = True
    return np.flatnonzero(here)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along axis 0) between row offsets; empty rows sum to 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
