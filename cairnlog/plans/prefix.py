"""Running totals over all rows of a table, without one task that sees them all.

The order is cut into blocks by range. Totals of blocks are summed up in a window without
a key, which sees one row per block; the rows of a block are summed up inside it. A table
that is no larger than a block needs no cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise

#: Rows of a block, as long as there are no more than ``BLOCKS`` of them.
BLOCK_ROWS = 65_536
BLOCKS = 4_096


def running_totals(
    frame: DataFrame, order: Sequence[str], totals: Mapping[str, str], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add, for every ``name: column`` of ``totals``, the sum of ``column`` over all earlier rows.

    ``order`` must be total; its first row gets 0. ``frame`` should be stored: it is counted,
    and read again to find the ranges.
    """
    blocks = min(BLOCKS, -(-frame.count() // block_rows))
    if blocks <= 1:
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = (F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in totals.items())
        return frame.select(*frame.columns, *sums)
    ranged = frame.repartitionByRange(blocks, *order).withColumn("_block", F.spark_partition_id())
    stored = materialise(ranged, "ordered-blocks")
    sums = stored.groupBy("_block").agg(*(F.sum(c).alias(f"_of_{n}") for n, c in totals.items()))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_block"), *(F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_of_{n}") for n in totals)
    )
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per block.
    placed = stored.join(F.broadcast(offsets), "_block")
    return placed.select(
        *frame.columns,
        *(
            (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_of_{n}")).alias(n)
            for n, c in totals.items()
        ),
    )
