"""Arrow batches in smaller pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece, in Arrow; as Python strings a text takes up to four times as much.
PIECE = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``size`` bytes, so that few long texts are Python objects at a time; empty batches are left out."""
    for b in batches:
        if not b.num_rows:
            continue
        rows = max(1, min(b.num_rows, int(b.num_rows * size / max(1, b.nbytes))))
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
