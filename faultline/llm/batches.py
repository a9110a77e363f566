"""Arrow batches cut by text bytes, shared by the operators that work inside ``mapInArrow``."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(raw(batch, column)), 0)).astype(np.int64) + 16
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(batch: pa.RecordBatch, column: str) -> pa.Array:
    """UTF-8 bytes of a text column."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text; null counts as empty."""
    return [b"" if t is None else t for t in raw(batch, column).to_pylist()]
