"""Questions with expected answers, made from the facts of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER, TEXT, LIST = "integer", "string_match", "list"


def _question(
    identity: str,
    text: str,
    kind: str,
    emit: Column,
    *,
    number: Column | None = None,
    texts: Column | None = None,
    tolerance: int = 0,
) -> Column:
    def typed(value: object, on: str, type_name: str) -> Column:
        return F.lit(value if kind == on else None).cast(type_name)

    return F.struct(
        F.coalesce(emit, F.lit(False)).alias("emit"),
        F.lit(identity).alias("id"),
        F.lit(text).alias("question"),
        F.lit(kind).alias("answer_type"),
        (F.lit(None) if number is None else number).cast("long").alias("expected_int"),
        (F.lit(None) if texts is None else texts).cast("array<string>").alias("expected_list"),
        typed(tolerance, INTEGER, "int").alias("tolerance"),
        typed(False, TEXT, "boolean").alias("case_sensitive"),
        typed(False, LIST, "boolean").alias("order_matters"),
    )


def _hour_forms(hour: Column) -> Column:
    return F.array(hour, F.concat(F.lit("hour "), hour), F.concat(hour, F.lit(":00")))


def _filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def generate_questions(facts: DataFrame) -> DataFrame:
    """Up to 18 question rows from the one row of ``log_facts``."""
    c = F.col
    always = F.lit(True)
    both_levels = (c("warning_count") > 0) & (c("info_count") > 0)
    info_wins = c("info_count") > c("warning_count")
    # Ids, wording, kinds, emission rules and tolerances.
    rows = [
        _question("q1_error_count", "How many ERROR level log entries are in this file?",
                  INTEGER, always, number=c("error_count")),
        _question("q2_total_lines", "How many total log lines are in this file?",
                  INTEGER, always, number=c("total_lines")),
        _question("q3_top_component", "Which component has the most log entries?",
                  TEXT, c("unique_components") > 0, texts=F.array("top_component")),
        _question("q4_top3_components", "What are the top 3 components by log volume?",
                  LIST, c("unique_components") >= 3, texts=c("top_components")),
        _question("q5_peak_error_hour", "During which hour did the most errors occur?",
                  TEXT, _filled(c("peak_error_hour")), texts=_hour_forms(c("peak_error_hour"))),
        _question("q6_warning_count", "How many WARNING level entries are there?",
                  INTEGER, c("warning_count") > 0, number=c("warning_count")),
        _question("q7_level_types", "What log levels are present in this file?",
                  LIST, always, texts=c("levels")),
        _question("q8_error_ratio",
                  "What percentage of log entries are errors? (answer as integer percentage)",
                  INTEGER, c("total_lines") > 0, tolerance=2,
                  number=F.rint(F.try_divide(c("error_count"), c("total_lines")) * 100)),
        _question("q9_unique_nodes", "How many unique nodes generated logs?",
                  INTEGER, always, number=c("unique_nodes")),
        _question("q10_busiest_node", "Which node generated the most logs?",
                  TEXT, _filled(c("busiest_node")), texts=F.array("busiest_node")),
        _question("q11_has_fatal",
                  "Are there any FATAL level logs in this file? (answer yes or no)",
                  TEXT, always,
                  texts=F.when(c("has_fatal"), F.array(*map(F.lit, ("yes", "true", "1"))))
                  .otherwise(F.array(*map(F.lit, ("no", "false", "0"))))),
        _question("q12_component_most_errors", "Which component generated the most ERROR logs?",
                  TEXT, _filled(c("component_with_most_errors")),
                  texts=F.array("component_with_most_errors")),
        _question("q13_info_error_ratio",
                  "What is the ratio of INFO logs to ERROR logs? (answer as integer, rounded)",
                  INTEGER, (c("error_count") > 0) & (c("info_count") > 0), tolerance=1,
                  number=F.rint(F.try_divide(c("info_count"), c("error_count")))),
        _question("q14_info_vs_warning",
                  "Which level appears more frequently: INFO or WARNING?", TEXT, both_levels,
                  texts=F.when(info_wins, F.array(F.lit("INFO"), F.lit("info")))
                  .otherwise(F.array(F.lit("WARNING"), F.lit("warning")))),
        _question("q15_quietest_hour", "During which hour were the fewest logs generated?",
                  TEXT, _filled(c("quietest_hour")), texts=_hour_forms(c("quietest_hour"))),
        _question("q16_busiest_hour", "During which hour were the most logs generated?",
                  TEXT, _filled(c("busiest_hour")), texts=_hour_forms(c("busiest_hour"))),
        _question("q17_nodes_vs_components",
                  "Are there more unique nodes or unique components?", TEXT,
                  (c("unique_nodes") > 0) & (c("unique_components") > 0),
                  texts=F.array(F.when(c("unique_nodes") > c("unique_components"), "nodes")
                                .otherwise("components"))),
        _question("q18_hours_with_errors", "How many hours had at least one ERROR log?",
                  INTEGER, c("hours_with_errors") > 0, number=c("hours_with_errors")),
    ]
    exploded = facts.select(F.explode(F.array(*rows)).alias("q")).where(F.col("q.emit"))
    return exploded.select("q.*").drop("emit")
