"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_ROWS = 1024
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, text: int | None = None, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and `size` bytes of its column number `text`
    (or one row). Spark's batches hold up to 10,000 rows and 64 MB, and what Python makes of
    a row takes many times its size; so only a slice is worked on at a time."""
    lengths = 0 if text is None else pc.binary_length(batch.column(text)).fill_null(0)
    ends = np.cumsum(np.broadcast_to(np.asarray(lengths, dtype=np.int64), batch.num_rows))
    first = before = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, before + size, "right"))
        last = min(max(last, first + 1), first + rows, batch.num_rows)
        yield batch.slice(first, last - first)
        first, before = last, int(ends[last - 1])
