"""Arrow batches in pieces of bounded bytes, for Python code that makes objects of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are made Python objects, or gathered for a batch, at once.
HELD_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """batch in pieces of HELD_BYTES of the column's text at most, or of one row; nothing is copied."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0)
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + HELD_BYTES, side="right")))
        yield batch.slice(at, to - at)
        at = to
