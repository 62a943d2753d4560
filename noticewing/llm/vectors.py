"""What the two operators on embedding vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(f"`{vec}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def same_width(df: DataFrame, vec: str) -> DataFrame:
    """`df` with the vectors' width as `_width`: only vectors of equal width are comparable."""
    return df.withColumn("_width", F.size(F.col(f"`{vec}`")))
