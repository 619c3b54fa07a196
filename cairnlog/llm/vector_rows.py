"""Vectors as whole numbers, rows that cannot be used left out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No scaled component may reach it; vectors of this size are refused, not rounded.
LIMIT = 2**31


def integer_vectors(
    table: DataFrame, scale: int, id_column: str, vector_column: str, label_column: str
) -> DataFrame:
    """``id, label, q`` with ``q`` the components times ``scale``, rounded down.

    Vectors that are null, empty or hold a null or a component that is not finite are
    left out. A scaled component of ``LIMIT`` or more ends the job with an error.
    """
    vector = F.col(vector_column)

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def scaled(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        wrong = F.raise_error(F.lit("a vector's component is too large")).cast("int")
        return F.when(F.abs(x.cast("double") * scale) < LIMIT - 1, value.cast("int")).otherwise(wrong)

    whole = table.where(vector.isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, usable))
    return whole.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).alias("label"),
        F.transform(vector, scaled).alias("q"),
    )


def usual_length(vectors: DataFrame) -> tuple[int, int]:
    """The most frequent length of ``q``, the greater one of two, and how many vectors have it."""
    lengths = vectors.groupBy(F.size("q").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    row = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return (0, 0) if row is None else (row["length"], row["n"])


def matrix(column: pa.Array, width: int, kind: str = "i8") -> np.ndarray:
    """A list column whose rows have ``width`` elements, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)
