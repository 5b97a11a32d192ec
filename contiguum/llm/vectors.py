"""Vectors in Arrow batches: checked, in double precision, with exact cosines that do not depend on the batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid row numbers, their vectors as float64).

    A vector is valid if it has ``dim`` finite components, none null, and is not zero.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n or not dim:
        return np.zeros(0, np.int64), np.zeros((0, dim))
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    there = ~np.asarray(column.is_null()) if column.null_count else np.ones(n, bool)
    rows = np.flatnonzero(there & (sizes == dim))
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    if values.null_count:
        flat[np.asarray(values.is_null())] = np.nan
    x = flat[offsets[rows][:, None] + np.arange(dim)]
    with np.errstate(over="ignore", invalid="ignore"):
        good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0.0) > 0)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so nothing over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines of unit rows, summed in a fixed order."""
    return (x * y).sum(1)


def most_common_dim(df, column: str) -> int:
    """The dimension that most vectors have; vectors of another one take no part."""
    from pyspark.sql import functions as F

    top = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return int(top["d"]) if top else 0
