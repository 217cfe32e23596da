"""Small helpers between Arrow columns and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds the next counts[i] of values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and each row's count."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(one, pa.ChunkedArray):
        one = pa.concat_arrays(one.chunks) if one.num_chunks else pa.array([], one.type)
    return one.flatten().to_numpy(zero_copy_only=False), np.diff(one.offsets.to_numpy())


def sections(counts: np.ndarray) -> np.ndarray:
    """The row number of each value, given the rows' counts."""
    return np.repeat(np.arange(len(counts)), counts)


def within(counts: np.ndarray) -> np.ndarray:
    """The place of each value in its row."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def new_groups(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one above it."""
    out = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = False
        for c in sorted_columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def parts(texts: list[bytes | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about size bytes together."""
    begin = 0
    while begin < len(texts):
        end, have = begin, 0
        while end < len(texts) and (end == begin or have < size):
            have += len(texts[end] or b"")
            end += 1
        yield begin, end
        begin = end
