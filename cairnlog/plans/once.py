"""Costly columns computed once per row.

A filter on a derived column is pushed below the projection that makes it, and there
the whole expression is evaluated again, for each use. That is right for cheap columns
and wrong for parsing a line or searching a text. A generated column is never pushed
below its generator, so what is derived here is evaluated exactly once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; none of ``columns`` may refer to another one of them."""
    row = F.struct(*(column.alias(name) for name, column in columns.items()))
    return frame.select("*", F.inline(F.array(row)))


def keep_records(frame: DataFrame, record: Column, fits: Column, *kept: str) -> DataFrame:
    """``kept`` columns and the fields of ``record`` of those rows that fit."""
    return frame.select(*kept, F.inline(F.when(fits, F.array(record))))
