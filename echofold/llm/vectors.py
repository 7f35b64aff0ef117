"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echofold.llm.common import small_batches


def dimension(df: DataFrame, vector: Column) -> int:
    """Length of the longest vector, 0 for a table without any."""
    small_batches(df.sparkSession)
    return int(df.agg(F.max(F.when(vector.isNotNull(), F.size(vector)))).first()[0] or 0)


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are whole, as doubles, and their positions.

    A NULL, a vector with a NULL or an entry that is not finite, and one shorter than `dim` (its
    further entries are missing) are left out.
    """
    off = np.asarray(column.offsets).astype(np.int64)
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(off) == dim))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = values[off[at][:, None] + np.arange(dim)]
    whole = np.isfinite(rows).all(axis=1)
    return rows[whole], at[whole]
