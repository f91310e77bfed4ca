"""Arrow batches in pieces of bounded size, so that Python holds few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece, but for a single longer text; and rows.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 2048


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = PIECE_BYTES, most_rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut where the texts or binaries of ``column`` make up ``most_bytes``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right"))), at + most_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
