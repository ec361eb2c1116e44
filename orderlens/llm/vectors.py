"""Vectors as the embedding operators see them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """True for a vector with components that are all finite, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(table: pa.Table | pa.RecordBatch, column: str) -> list[np.ndarray]:
    """Row numbers grouped by the length of their vector."""
    lengths = np.array(table.column(column).combine_chunks().value_lengths()
                       if isinstance(table, pa.Table) else table.column(column).value_lengths())
    return [np.flatnonzero(lengths == n) for n in np.unique(lengths)]


def double_vectors(df: DataFrame, column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")
