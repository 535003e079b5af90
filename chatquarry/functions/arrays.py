"""Vectors in Arrow batches as matrices, and what columns say of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(column: str) -> Column:
    """Whether a vector is there and has a length other than 0."""
    return F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))
