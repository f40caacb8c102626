"""Columns of vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192


def finite(vector: str) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    def good(x: Column) -> Column:
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def first_by_hash(df: DataFrame, keys: list[str], total: int, size: int) -> DataFrame:
    """The ``size`` rows of ``total`` that come first by a hash of ``keys``, which tell rows apart.

    Each task of a sorted limit hands over ``size`` rows of its own, which grows with the
    table. So rows are left out first whose hash cannot be among the first, by all that is
    likely: some twice the rows asked for stay, in all tasks together.
    """
    order = F.xxhash64(*keys, F.lit("sample"))
    share = (2 * size + 1000) / max(total, 1)
    near = df if share >= 1 else df.where(order < F.lit(int(share * 2**64) - 2**63).cast("long"))
    return near.orderBy(order, *keys).limit(size)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The vectors, ``dims`` components each, as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; the largest component is divided out first, so that nothing overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)
