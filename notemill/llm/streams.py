"""Helpers for Python workers that read sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal integer keys; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change)]
        ends = np.r_[starts[1:], b.num_rows]
        for s, e in zip(starts, ends, strict=True):
            key = tuple(int(c[s]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(s, e - s))
    if held:
        yield now, pa.Table.from_batches(held)


def fixed_rows(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """A binary column of equal-length non-null values as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.binary())
    n = len(a)
    if not n:
        return np.zeros((0, 0), dtype)
    offsets = np.frombuffer(a.buffers()[1], np.int32 if a.type == pa.binary() else np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(n, -1).view(dtype)
