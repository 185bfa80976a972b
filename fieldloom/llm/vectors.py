"""Vectors as blocks of NumPy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Not null, not empty, every component finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(column) > 0) & ~bad, F.lit(False))


def by_dimension(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of vector in the column, which has no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values).astype(np.float64)
    lengths = np.diff(offsets)
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(d)]))
    return out
