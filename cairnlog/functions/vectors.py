"""Array arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two numeric arrays of one length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays zero."""
    # The length is repeated as an array so that it is computed once per row; inside
    # the lambda it would be computed again for every element.
    lengths = F.array_repeat(F.sqrt(dot(vector, vector)), F.size(vector))
    return F.zip_with(
        vector,
        lengths,
        lambda x, length: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)),
    )
