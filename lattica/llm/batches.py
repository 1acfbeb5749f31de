"""Arrow batches cut into slices of bounded text, for operators that run numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice holds at most, but for one longer document.
SLICE_BYTES = 2_000_000


def slices(batches: Iterable[pa.RecordBatch], text: int, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts), null as empty; ``text`` is the column's place. Only a slice's texts become Python strings."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = held = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, held + size, "right")))
            part = batch.slice(start, stop - start)
            yield part, [v or "" for v in part.column(text).to_pylist()]
            start, held = stop, int(ends[stop - 1])
