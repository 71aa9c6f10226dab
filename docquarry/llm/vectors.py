"""What operators on vectors share: which vectors count, and how they leave Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def usable(vector: Column, most: float = float("inf")) -> Column:
    """Whether a vector is there and all its components are, as finite numbers, below `most` in size."""
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))
    return F.coalesce(vector.isNotNull() & fits, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length, without nulls, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)
