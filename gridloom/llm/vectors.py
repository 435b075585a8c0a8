"""Vectors of a table as NumPy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Whether a vector is not null, not zero and holds finite components only."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def block(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The rows of a matrix as a list column."""
    kind = kind or pa.float64()
    offsets = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1] if matrix.size else 1, dtype=np.int32)[: len(matrix) + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=kind))
