"""Vectors as whole numbers, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 22  # scaled components stay below it, so that squared distances are exact


def usable(vector: Column) -> Column:
    """True for a vector without NULL, NaN or infinite components; the empty vector is usable."""
    def broken(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vector.isNotNull() & ~F.coalesce(F.exists(vector, broken), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """Every component as ``floor(scale * x)``; one beyond 2^22 fails the job with a message."""
    def whole(x: Column) -> Column:
        big = x.cast("double") * scale
        return F.when(F.abs(big) < LARGEST, F.floor(big)).otherwise(
            F.raise_error(F.lit("a vector component is too large to be scaled")).cast("bigint")).cast("int")

    return F.transform(vector, whole)


def width_of(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """A list column as a matrix; components that a shorter vector lacks are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))
