"""Columns of bases and qualities as flat numpy arrays, for steps in Arrow batches: a row of a batch is a run of the array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What stands for a missing quality.
NO_QUALITY = -1


def _bounds(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_list(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all letters, bounds of the rows) of a text column of one-byte letters; a null is empty."""
    bounds = _bounds(column)
    data = column.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return codes, bounds - bounds[0]


def numbers(column: pa.Array, missing: int = NO_QUALITY) -> tuple[np.ndarray, np.ndarray]:
    """(all values, bounds of the rows) of an array column; a null is empty."""
    bounds = _bounds(column)
    values = column.values.slice(bounds[0], bounds[-1] - bounds[0])
    return values.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64), bounds - bounds[0]


def places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of each element."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row, np.arange(bounds[-1]) - bounds[row]


def at(values: np.ndarray, bounds: np.ndarray, row: np.ndarray, place: np.ndarray, missing: int) -> np.ndarray:
    """The value at a place of a row, or `missing` outside of it."""
    inside = (place >= 0) & (place < np.diff(bounds)[row])
    if not len(values):
        return np.full(len(row), missing, np.int64)
    return np.where(inside, values[np.where(inside, bounds[row] + place, 0)], missing)


def text_column(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(codes, np.uint8))])


def number_column(values: np.ndarray, bounds: np.ndarray, missing: int | None = NO_QUALITY) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32), mask=values == missing if missing is not None else None))


def whole(column: pa.Array, missing: int = 0) -> np.ndarray:
    return column.fill_null(missing).to_numpy(zero_copy_only=False).astype(np.int64)
