"""Dense numbers without a global or per-key sort in one task.

``number_scan_rows`` numbers the rows of a file scan in file order. A scan split is
read in order by one task, so a row's place inside its split is a difference of
``monotonically_increasing_id`` values; only one count per split is shuffled.

``number_in_groups`` is ``row_number`` for groups of any size. The order of a group
is cut into segments; segments are counted, the counts are summed up, and rows are
only ranked inside their segment. A key with a third of all rows becomes many small
window partitions instead of a single huge one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import materialise
from .prefix import running_totals


def pin_splits(spark: SparkSession) -> None:
    """Keep the splits of a scan the same from one job to the next.

    By default they depend on the number of cores at the time, which changes when
    executors come and go.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(1, spark.sparkContext.defaultParallelism)))


def number_scan_rows(rows: DataFrame, name: str, *, per_file: bool = True) -> DataFrame:
    """Add 1-based ``name`` to a narrow transformation of a scan.

    ``rows`` has ``file`` and ``split_start`` (see ``sources.logs.read_log_lines``) and
    no shuffle since the scan. ``per_file`` restarts at 1 in every file; otherwise
    numbers run on over the files in name order.
    """
    pin_splits(rows.sparkSession)
    tagged = rows.withColumn("_seq", F.monotonically_increasing_id())
    splits = tagged.groupBy("file", "split_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_base")
    )
    # One row per split, so the sums below see splits, never lines.
    if per_file:
        order = Window.partitionBy("file").orderBy("split_start")
        before = F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
        placed = splits.withColumn("_before", F.coalesce(before, F.lit(0)))
    else:
        counted = materialise(splits, "split-counts")
        placed = running_totals(counted, ["file", "split_start"], {"_before": "_rows"})
    shift = F.col("_before") - F.col("_base") + 1
    offsets = materialise(placed.select("file", "split_start", shift.alias("_shift")), "split-offsets")
    # A split that the first pass did not see must stop the job, not lose its rows.
    unseen = F.raise_error(F.lit("scan splits changed between two passes")).cast("long")
    shift = F.coalesce(F.col("_shift"), unseen)
    return (
        tagged.join(offsets, ["file", "split_start"], "left")
        .withColumn(name, F.col("_seq") + shift)
        .drop("_seq", "_shift")
    )


def number_in_groups(
    frame: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    name: str,
    *,
    whole: Mapping[str, tuple[Column, Callable[[Column], Column]]] | None = None,
) -> DataFrame:
    """Add ``name``: the exact 1-based rank of each row within ``keys`` by ``order``.

    ``segment`` must not decrease along ``order``. ``order`` must be total. ``whole`` adds
    aggregates of the whole group: for each name one of a segment's rows, and the function
    that combines those of the segments. They come with the segments' counts, so no row
    is joined on the keys alone.
    """
    whole = whole or {}
    tagged = frame.withColumn("_segment", segment)
    cells = [*keys, "_segment"]
    counts = tagged.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("_rows"), *(part.alias(f"_part_{n}") for n, (part, _) in whole.items())
    )
    group = Window.partitionBy(*keys)
    before = F.sum("_rows").over(group.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        *cells,
        F.coalesce(before, F.lit(0)).alias("_before"),
        *(combine(F.col(f"_part_{n}")).over(group).alias(n) for n, (_, combine) in whole.items()),
    )
    inside = Window.partitionBy(*cells).orderBy(*order)
    return (
        tagged.join(offsets, cells)
        .withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_segment", "_before")
    )
