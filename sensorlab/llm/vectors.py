"""Integer vectors from an embedding column, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sound(v: Column) -> Column:
    """A vector without null, NaN or infinite components."""
    def bad(c):
        d = c.cast("double")
        return c.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad)


def integer_rows(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): ``x`` is floor(scale * component) of every sound vector, as
    longs (values beyond 64 bits become the nearest long).  Rows whose vector
    is null or holds null or non-finite components are left out."""
    v = F.col(f"`{vec_col}`")
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))
    return df.where(_sound(v)).select(F.col(f"`{id_col}`").alias("id"), x.alias("x"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    """``x`` of every row with zeros up to ``width`` components."""
    short = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < width, F.concat("x", short)).otherwise(F.col("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<int64> column of equal lengths as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.int64).reshape(len(column), width)
