"""Arrow batches in pieces of bounded size.

Spark cuts Arrow batches by rows, so a batch holds as many tokens as its texts
have.  Code that makes Python objects or work arrays of them goes through a
batch in slices of bounded content; a single row is never cut.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens, ids or list entries, and bytes of text, that are worked on at a time.
SLICE_ITEMS, SLICE_TEXT = 1 << 17, 1 << 19


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text or entries of each list; a null has none."""
    kind = column.type
    n = pc.binary_length(column) if pa.types.is_string(kind) or pa.types.is_large_string(kind) else column.value_lengths()
    return n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(of: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of consecutive pieces whose sizes add up to
    ``most`` at the utmost; a larger row is a piece of its own.  Each row counts
    one more, so that empty rows are not piled up without end."""
    ends, start = np.cumsum(of + 1), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop - start
        start = stop


def cut(batches: Iterator[pa.RecordBatch], names: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of batches in which the columns ``names`` together hold ``most``
    entries (``SLICE_ITEMS``) at the utmost, or one row."""
    for b in batches:
        for start, n in slices(sum(sizes(b.column(b.schema.get_field_index(c))) for c in names), most or SLICE_ITEMS):
            yield b.slice(start, n)
