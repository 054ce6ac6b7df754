"""Arrow batches cut by bytes, so that what a task makes of one is bounded whatever the rows hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 2 << 20


def cut(batches: Iterator[pa.RecordBatch], column: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, as slices with about ``most`` bytes in a text column, or one
    row that has more. Nothing is copied."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        part = np.cumsum(sizes, dtype=np.int64) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, end - start)
