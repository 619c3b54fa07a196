"""Text-table operators on lines (``file``, ``line_no``, ``value``).

``line_no`` is dense from 1 in every file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import fields, strip
from ..plans.durable import materialise

LINES_PER_SEGMENT = 100_000
ROWS_PER_BLOCK = 100_000


def _matches(pattern: str, ignore_case: bool) -> Column:
    return F.col("value").rlike(("(?i)" if ignore_case else "") + pattern)


def grep(
    lines: DataFrame, pattern: str, *, ignore_case: bool = False, invert: bool = False
) -> DataFrame:
    found = _matches(pattern, ignore_case)
    return lines.where(~found if invert else found)


def grep_count(lines: DataFrame, pattern: str, *, ignore_case: bool = False) -> DataFrame:
    """Matching lines per file."""
    return lines.groupBy("file").agg(F.count_if(_matches(pattern, ignore_case)).alias("count"))


def wc(lines: DataFrame) -> DataFrame:
    """Lines, words and characters (with line ends) per file."""
    text = strip(F.col("value"))
    words = F.when(text == "", 0).otherwise(F.size(fields(text)))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(words).alias("words"),
        F.sum(F.length("value") + 1).alias("chars"),
    )


def cut(lines: DataFrame, delimiter: str, fields: Sequence[int]) -> DataFrame:
    """Fields by 1-based number, as ``f1``, ``f2`` and so on; null where a line is short."""
    part = F.split(F.col("value"), delimiter)
    return lines.select(
        "file", "line_no", *(F.try_element_at(part, F.lit(n)).alias(f"f{n}") for n in fields)
    )


def sort_lines(
    lines: DataFrame, key: Column | None = None, *, numeric: bool = False, descending: bool = False
) -> DataFrame:
    """Lines by value or ``key``; equal keys keep their place.

    File and line number belong to the sort key, so the range partitioning can divide a
    key that very many lines share.
    """
    by = F.col("value") if key is None else key
    if numeric:
        by = F.coalesce(by.try_cast("double"), F.lit(0.0))
    return lines.orderBy(by.desc() if descending else by.asc(), "file", "line_no")


def uniq_adjacent(lines: DataFrame, segment: int = LINES_PER_SEGMENT) -> DataFrame:
    """Lines that differ from the line before them.

    Files are cut into segments; the last line of a segment is also handed to the next
    one, so each segment can be looked at on its own.
    """
    place = F.col("line_no") - 1
    own = F.floor(place / segment)
    ends = place % segment == segment - 1
    spread = lines.withColumn(
        "_segment", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    before = F.lag("value").over(Window.partitionBy("file", "_segment").orderBy("line_no"))
    return (
        spread.withColumn("_before", before)
        .where((F.col("_segment") == own) & ~F.col("_before").eqNullSafe(F.col("value")))
        .drop("_segment", "_before")
    )


def value_counts(lines: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent lines."""
    counts = lines.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(k)


def head(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` lines of every file."""
    return lines.where(F.col("line_no") <= n)


def tail(lines: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` lines of every file."""
    # One row per file, written so that Catalyst can check its size for a broadcast.
    ends = materialise(lines.groupBy("file").agg(F.max("line_no").alias("_last")), "file-ends")
    return (
        lines.join(ends, "file").where(F.col("line_no") > F.col("_last") - n).drop("_last")
    )


def substitute(lines: DataFrame, pattern: str, replacement: str) -> DataFrame:
    return lines.withColumn("value", F.regexp_replace("value", pattern, replacement))


def translate(lines: DataFrame, matching: str, replacing: str) -> DataFrame:
    return lines.withColumn("value", F.translate("value", matching, replacing))


def join_fields(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of two field tables; AQE divides partitions of hot keys."""
    return left.join(right, key)


def _value_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """How often each value occurs on either side."""
    sides = left.select("value", F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        right.select("value", F.lit(0), F.lit(1))
    )
    return sides.groupBy("value").agg(F.sum("l").alias("left"), F.sum("r").alias("right"))


def _repeated(counts: DataFrame, times: Column) -> DataFrame:
    """Each value ``times`` times; a very frequent one is written out by many tasks."""
    block = F.lit(ROWS_PER_BLOCK)
    blocks = counts.select("value", times.cast("long").alias("n")).where(F.col("n") > 0)
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))
    rows = F.least(block, F.col("n") - F.col("_block") * block).cast("int")
    spread = blocks.select("value", "_block", rows.alias("_rows")).repartition("value", "_block")
    return spread.select("value", F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_row")).drop(
        "_row"
    )


def common_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values in both, as often as in the side that has fewer."""
    return _repeated(_value_sides(left, right), F.least("left", "right"))


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Values of the left side beyond their number on the right."""
    return _repeated(_value_sides(left, right), F.col("left") - F.col("right"))


def only_right(left: DataFrame, right: DataFrame) -> DataFrame:
    return only_left(right, left)


def paste(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines of two files side by side with a tab between them."""
    a = left.select("line_no", F.col("value").alias("_a"))
    b = right.select("line_no", F.col("value").alias("_b"))
    empty = F.lit("")
    return a.join(b, "line_no", "full_outer").select(
        "line_no",
        F.concat_ws("\t", F.coalesce("_a", empty), F.coalesce("_b", empty)).alias("value"),
    )


def union_files(*files: DataFrame) -> DataFrame:
    whole = files[0]
    for lines in files[1:]:
        whole = whole.unionByName(lines)
    return whole
