"""Vectors of floating-point numbers as vectors of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(rows: DataFrame, column: str, scale: int, most: int) -> DataFrame:
    """rows with v: floor(scale * x) of each component of a vector.

    Rows whose vector is null, or holds a null or non-finite component, go. A component beyond
    +-most after scaling counts as +-most, so that sums of products stay exact.
    """
    vector = F.col(column).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    return rows.where(vector.isNotNull() & ~bad).withColumn("v", whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones end in zeros."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    size = np.diff(bounds)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], size)] = flat
    return out
