"""Vector tables: which rows take part, and arrays in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite."""
    inf = float("inf")
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf)),
                      F.lit(False))


def one_per_id(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles): of rows with the same id, the smallest finite
    vector in array order. Rows with a null id or without a finite vector are left out."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return v.where(F.col("vec_id").isNotNull() & finite(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(vectors, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of arrays as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), dim), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def list_matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """As :func:`matrix`, of a list array of doubles without nulls."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out
