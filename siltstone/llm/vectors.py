"""Vectors of an Arrow batch as matrices, and the sums of small arrays over all partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def matrices(batch: pa.RecordBatch, column: str):
    """(length, row numbers, matrix of doubles) for each vector length in the batch.

    Rows whose vector is null or holds null or non-finite entries are left out.
    """
    arr = batch.column(column)
    lengths = pc.fill_null(pc.list_value_length(arr), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = arr.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    held = np.maximum(lengths, 0)
    first = np.cumsum(held) - held
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        m = values[first[rows][:, None] + np.arange(n)]
        ok = np.isfinite(m).all(axis=1)
        if ok.any():
            yield n, rows[ok], m[ok]


def scaled(m: np.ndarray, factor: int, most: int) -> np.ndarray:
    """floor(factor * m) as int64, held within -most to most."""
    return np.clip(np.floor(factor * m), -most, most).astype(np.int64)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column."""
    m, n = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * n), pa.array(values.reshape(-1)))


def summed(partials: DataFrame, keys: list[str], column: str = "v") -> DataFrame:
    """Element-wise sums of the list column over the rows of equal keys, as (keys, at, column)."""
    return partials.select(*keys, F.posexplode(column).alias("at", column)).groupBy(*keys, "at").agg(F.sum(column).alias(column))
