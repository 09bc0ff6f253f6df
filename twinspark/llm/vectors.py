"""Vectors as whole numbers, for the operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components stay below this, so that squares and products of up to 512 components fit 64 bits.
MOST = 2**26


def sound(vector: Column, width: int | None = None) -> Column:
    """Whether a vector is there, without null, NaN or infinite components, and of that width."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) == width if width is not None else F.lit(True)), F.lit(False))


def whole_numbers(vectors: pa.ListArray, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of every component, a row a vector, shorter vectors with zeros behind them.

    Raises if a component is too large to be compared in 64 bits.
    """
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if flat.size and np.abs(flat).max() >= MOST:
        raise ValueError(f"a component times {scale} is not below {MOST}")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def as_bytes(matrix: np.ndarray, kind: str) -> pa.Array:
    """A binary value for each row."""
    matrix = np.ascontiguousarray(matrix, kind)
    step = matrix.shape[1] * matrix.itemsize
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer((np.arange(len(matrix) + 1) * step).astype("<i4")), pa.py_buffer(matrix)])


def from_bytes(values: pa.Array, kind: str, width: int) -> np.ndarray:
    """What ``as_bytes`` was given."""
    start, size = np.frombuffer(values.buffers()[1], "<i4")[values.offset], len(values) * width * np.dtype(kind).itemsize
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[start : start + size].view(kind).reshape(len(values), width)
