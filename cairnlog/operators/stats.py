"""Counts and facts about parsed lines.

Input is a frame of parsed lines (``line_no``, ``timestamp``, ``node_id``, ``level``,
``component``, ``message``) whose ``line_no`` is unique over all of them. Equal counts
are ordered by first appearance.

Counting keeps to two longs per key (rows, first line), which Spark aggregates by
hash on the map side; picks such as "busiest hour" look at those counts only.
``line_counts`` reduces all lines to their distinct (level, component, node, hour)
combinations once; every function here takes its result in place of the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.parsing import bgl_node_record, fields, hour_of
from ..plans.durable import materialise
from ..plans.once import add_once, keep_records


def parse_lines(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """Parsed lines from raw ones; lines of another shape are dropped."""
    cut = lines.select("line_no", fields(F.col(value), 10).alias("part"))
    part = F.col("part")
    return keep_records(cut, bgl_node_record(part), F.size(part) >= 10, "line_no")


def line_counts(parsed: DataFrame, *, patterns: bool = False) -> DataFrame:
    """Lines counted per level, component, node and hour; with ``patterns`` also by the
    pattern of ERROR lines, null for others."""
    keys = ["level", "component", "node_id", hour_of(F.col("timestamp")).alias("hour")]
    if patterns:
        keys.append(F.when(F.col("level") == "ERROR", _pattern(F.col("message"))).alias("pattern"))
    return parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"))


def _tally(frame: DataFrame, *keys: Column | str, where: Column | None = None) -> DataFrame:
    """``count`` and ``first_line`` per key, from lines or from ``line_counts``."""
    counted = "first_line" in frame.columns
    if where is not None:
        frame = frame.where(where)
    return frame.groupBy(*keys).agg(
        (F.sum("count") if counted else F.count(F.lit(1))).alias("count"),
        F.min("first_line" if counted else "line_no").alias("first_line"),
    )


def _hour(frame: DataFrame) -> Column:
    return (F.col("hour") if "hour" in frame.columns else hour_of(F.col("timestamp"))).alias("hour")


def _top(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), "first_line").limit(k)


def _only(counts: DataFrame, key: str, name: str, order: Column) -> DataFrame:
    return counts.agg(F.min_by(F.col(key), F.struct(order, F.col("first_line"))).alias(name))


def _rows(frame: DataFrame) -> Column:
    return F.sum("count") if "first_line" in frame.columns else F.count(F.lit(1))


def _rows_of(frame: DataFrame, level: str) -> Column:
    one = F.col("count") if "first_line" in frame.columns else F.lit(1)
    return F.coalesce(F.sum(F.when(F.col("level") == level, one)), F.lit(0)).cast("long")


def total_lines(frame: DataFrame) -> DataFrame:
    return frame.agg(F.coalesce(_rows(frame), F.lit(0)).alias("total_lines"))


def level_counts(frame: DataFrame) -> DataFrame:
    return _tally(frame, "level")


def component_counts(frame: DataFrame, k: int = 10) -> DataFrame:
    return _top(_tally(frame, "component"), k)


def node_counts(frame: DataFrame, k: int = 10) -> DataFrame:
    return _top(_tally(frame, "node_id"), k)


def hour_counts(frame: DataFrame) -> DataFrame:
    """Lines per hour of day; malformed timestamps are left out."""
    return _tally(frame, _hour(frame)).where(F.col("hour").isNotNull())


def hour_level_counts(frame: DataFrame) -> DataFrame:
    return _tally(frame, _hour(frame), "level").where(F.col("hour").isNotNull())


def hour_level_map(frame: DataFrame) -> DataFrame:
    """One row per hour with its level counts as a map."""
    return (
        hour_level_counts(frame)
        .groupBy("hour")
        .agg(F.map_from_entries(F.collect_list(F.struct("level", "count"))).alias("levels"))
    )


def _pattern(message: Column) -> Column:
    """The first five lower-case words of a message; null with fewer than three words."""
    return let(
        fields(F.lower(message), 6),
        lambda words: F.when(F.size(words) >= 3, F.array_join(F.slice(words, 1, 5), " ")),
    )


def error_patterns(frame: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent patterns of ERROR messages, from lines or from counts with patterns."""
    if "pattern" not in frame.columns:
        errors = frame.where(F.col("level") == "ERROR").select("line_no", "message")
        frame = add_once(errors, {"pattern": _pattern(F.col("message"))})
    return _top(_tally(frame.where(F.col("pattern").isNotNull()), "pattern"), k)


def _hour_errors(frame: DataFrame) -> DataFrame:
    counted = "first_line" in frame.columns
    one = F.col("count") if counted else F.lit(1)
    return (
        frame.groupBy(_hour(frame))
        .agg(
            F.sum(F.when(F.col("level") == "ERROR", one).otherwise(0)).alias("errors"),
            F.sum(one).alias("count"),
            F.min("first_line" if counted else "line_no").alias("first_line"),
        )
        .where(F.col("hour").isNotNull())
    )


def peak_error_hour(frame: DataFrame) -> DataFrame:
    """The hour with most ERROR lines; the first hour seen when there are none."""
    return _only(_hour_errors(frame), "hour", "peak_error_hour", -F.col("errors"))


def time_span(parsed: DataFrame) -> DataFrame:
    """Timestamps of the first and the last line in file order."""
    return parsed.agg(
        F.min_by("timestamp", "line_no").alias("start"), F.max_by("timestamp", "line_no").alias("end")
    )


def unique_counts(frame: DataFrame, *, approximate: float | None = None) -> DataFrame:
    """Numbers of distinct nodes and components: exact, or within a relative error."""
    if approximate is not None:
        return frame.agg(
            F.approx_count_distinct("node_id", approximate).alias("unique_nodes"),
            F.approx_count_distinct("component", approximate).alias("unique_components"),
        )
    # Pairs first: the distinct counts then expand few rows instead of every line.
    pairs = frame.select("node_id", "component").distinct()
    return pairs.agg(
        F.count_distinct("node_id").alias("unique_nodes"),
        F.count_distinct("component").alias("unique_components"),
    )


def busiest_hour(frame: DataFrame) -> DataFrame:
    return _only(hour_counts(frame), "hour", "busiest_hour", -F.col("count"))


def quietest_hour(frame: DataFrame) -> DataFrame:
    return _only(hour_counts(frame), "hour", "quietest_hour", F.col("count"))


def busiest_node(frame: DataFrame) -> DataFrame:
    return _only(_tally(frame, "node_id"), "node_id", "busiest_node", -F.col("count"))


def hours_with_errors(frame: DataFrame) -> DataFrame:
    """Hours with at least one ERROR line."""
    return _hour_errors(frame).where(F.col("errors") > 0).select("hour", "errors")


def component_error_counts(frame: DataFrame, k: int = 10) -> DataFrame:
    return _top(_tally(frame, "component", where=F.col("level") == "ERROR"), k)


def component_with_most_errors(frame: DataFrame) -> DataFrame:
    errors = _tally(frame, "component", where=F.col("level") == "ERROR")
    return _only(errors, "component", "component_with_most_errors", -F.col("count"))


def info_warning_counts(frame: DataFrame) -> DataFrame:
    return frame.agg(
        _rows_of(frame, "INFO").alias("info_count"),
        _rows_of(frame, "WARNING").alias("warning_count"),
    )


def error_ratio(frame: DataFrame) -> DataFrame:
    """ERROR lines in percent of all, rounded half to even; null without lines."""
    share = _rows_of(frame, "ERROR") / _rows(frame) * 100
    return frame.agg(
        F.when(_rows(frame) > 0, F.rint(share).cast("long")).alias("error_ratio")
    )


def info_error_ratio(frame: DataFrame) -> DataFrame:
    """INFO per ERROR line, rounded half to even; null unless both occur."""
    info, errors = _rows_of(frame, "INFO"), _rows_of(frame, "ERROR")
    return frame.agg(
        F.when((info > 0) & (errors > 0), F.rint(F.try_divide(info, errors)).cast("long")).alias(
            "info_error_ratio"
        )
    )


def log_facts(frame: DataFrame) -> DataFrame:
    """One row with everything the questions are made of.

    All key counts come out of one pass of grouping sets over ``line_counts``.
    """
    # Two uses below: the counts are written once instead of counting all lines twice.
    cells = frame if "first_line" in frame.columns else materialise(line_counts(frame), "counts")
    names = ["level", "component", "node_id", "hour"]
    errors = F.when(F.col("level") == "ERROR", F.col("count")).otherwise(0)
    keyed = (
        cells.withColumn("errors", errors)
        .withColumn("error_line", F.when(F.col("errors") > 0, F.col("first_line")))
        .groupingSets([[F.col(n)] for n in names], *(F.col(n) for n in names))
        .agg(
            F.sum("count").alias("count"),
            F.sum("errors").alias("errors"),
            F.min("first_line").alias("first_line"),
            F.min("error_line").alias("error_line"),
            *(F.grouping(n).alias(f"no_{n}") for n in names),
        )
    )

    def here(name: str, value: Column) -> Column:
        return F.when(F.col(f"no_{name}") == 0, value)

    def pick(name: str, order: Column, line: str = "first_line", ok: Column | None = None) -> Column:
        ranked = F.struct(order, F.col(line))
        usable = F.col(name).isNotNull() if ok is None else F.col(name).isNotNull() & ok
        return F.min_by(F.col(name), here(name, F.when(usable, ranked)))

    def level_rows(level: str) -> Column:
        found = F.sum(F.when(F.col("level") == level, here("level", F.col("count"))))
        return F.coalesce(found, F.lit(0))

    more, less = -F.col("count"), F.col("count")
    facts = keyed.agg(
        F.coalesce(F.sum(here("level", F.col("count"))), F.lit(0)).alias("total_lines"),
        level_rows("ERROR").alias("error_count"),
        level_rows("WARNING").alias("warning_count"),
        level_rows("INFO").alias("info_count"),
        (level_rows("FATAL") > 0).alias("has_fatal"),
        # One entry per distinct level, in order of appearance.
        F.transform(
            F.array_sort(F.collect_list(here("level", F.struct("first_line", "level")))),
            lambda x: x["level"],
        ).alias("levels"),
        F.count(here("node_id", F.lit(1))).alias("unique_nodes"),
        F.count(here("component", F.lit(1))).alias("unique_components"),
        pick("component", more).alias("top_component"),
        pick("node_id", more).alias("busiest_node"),
        pick("component", -F.col("errors"), "error_line", F.col("errors") > 0).alias(
            "component_with_most_errors"
        ),
        pick("hour", -F.col("errors")).alias("peak_error_hour"),
        pick("hour", more).alias("busiest_hour"),
        pick("hour", less).alias("quietest_hour"),
        F.count(here("hour", F.when(F.col("hour").isNotNull() & (F.col("errors") > 0), 1))).alias(
            "hours_with_errors"
        ),
    )
    top = component_counts(cells, 3)
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("count"), "first_line", "component")))
    names_of_top = top.agg(F.transform(ordered, lambda x: x["component"]).alias("names"))
    return facts.withColumn("top_components", names_of_top.scalar())


def _counts_and_span(parsed: DataFrame) -> tuple[DataFrame, dict[str, str | None]]:
    """Stored counts with patterns, and the time span, from one pass over the lines."""
    names = {"start": F.min_by("timestamp", "line_no"), "end": F.max_by("timestamp", "line_no")}
    if parsed.isEmpty():
        return materialise(line_counts(parsed, patterns=True), "counts"), dict.fromkeys(names)
    # Seen while counting. A task that runs twice does not change the first or last line.
    seen = Observation()
    watched = parsed.observe(seen, *(value.alias(name) for name, value in names.items()))
    return materialise(line_counts(watched, patterns=True), "counts"), seen.get


def statistics_rows(parsed: DataFrame) -> DataFrame:
    """Every statistic in long form: section, key, subkey, value (text).

    The lines are parsed once; all sections come from their counts.
    """
    cells, span_of = _counts_and_span(parsed)

    def rows(section: str, frame: DataFrame, key: str, subkey: Column, value: Column) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            F.col(key).alias("key"),
            subkey.cast("string").alias("subkey"),
            value.cast("string").alias("value"),
        )

    none, count = F.lit(None), F.col("count")
    parts = [
        rows("level_counts", level_counts(cells), "level", none, count),
        rows("component_counts", component_counts(cells), "component", none, count),
        rows("node_counts", node_counts(cells), "node_id", none, count),
        rows("hour_counts", hour_counts(cells), "hour", none, count),
        rows("hour_level_counts", hour_level_counts(cells), "hour", F.col("level"), count),
        rows("error_patterns", error_patterns(cells), "pattern", none, count),
        rows("component_error_counts", component_error_counts(cells), "component", none, count),
        rows("hours_with_errors", hours_with_errors(cells), "hour", none, F.col("errors")),
    ]
    ends = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(span_of[k]).cast("string").alias("value")) for k in ("start", "end")))
    span = parsed.sparkSession.range(1).select(F.inline(ends))
    parts.append(rows("time_span", span, "key", none, F.col("value")))
    scalars = (
        "total_lines", "error_count", "info_count", "warning_count", "unique_nodes",
        "unique_components", "peak_error_hour", "busiest_hour", "quietest_hour", "busiest_node",
        "component_with_most_errors",
    )
    facts = log_facts(cells).select(
        F.explode(
            F.array(
                *(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value"))
                  for n in scalars)
            )
        ).alias("fact")
    ).select("fact.*")
    parts.append(rows("facts", facts, "key", none, F.col("value")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
