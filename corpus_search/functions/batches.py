"""Arrow batches in parts of bounded size, so that what a task makes of a batch doesn't grow with its texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows of a part.
PART_BYTES = 2 << 20
PART_ROWS = 1024


def parts(batch: pa.RecordBatch, column: str, most_bytes: int = PART_BYTES, most_rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut into parts of at most ``most_rows`` rows and about ``most_bytes`` of ``column``
    (a part has a row at least). A batch without rows is one part."""
    if not batch.num_rows:
        yield batch
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    end, lo = size.cumsum(), 0
    while lo < len(size):
        before = end[lo - 1] if lo else 0
        hi = min(lo + most_rows, max(lo + 1, int(np.searchsorted(end, before + most_bytes, side="right"))), len(size))
        yield batch.slice(lo, hi - lo)
        lo = hi
