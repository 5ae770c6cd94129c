"""Helpers all operators of this subpackage share: intermediate tables and slices of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.cells import fresh
from millrace.sources.scratch import settled as settle

__all__ = ["BROADCAST_ROWS", "SLICE_BYTES", "fresh", "settle", "sized", "text_slices"]

#: Bytes of text one step inside a task works on. A longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into ``(first row, end row, bytes, offsets)`` of about ``limit`` bytes; null texts are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(at, np.int64, n + 1, 8 * column.offset)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


#: Tables of narrow rows up to this count are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, are at most ``limit``. Give it settled tables only."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
