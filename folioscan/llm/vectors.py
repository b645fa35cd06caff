"""Reading vectors: which rows take part, and as what."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the rows that have an id and a finite vector of one component or more.

    Rows that share an id count once, with their least vector.
    """
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None, dtype=np.float64) -> np.ndarray:
    """A list column as a matrix; shorter rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = width or int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    at = 0
    for i, n in enumerate(sizes):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out
