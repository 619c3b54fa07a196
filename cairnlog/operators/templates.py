"""Message templates: counting, checking and refining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import message_body, mine_template


def template_of(raw_line: Column) -> Column:
    return mine_template(message_body(raw_line))


def check_template(raw_line: Column, template: Column) -> Column:
    """The template if it is right for the line, else the corrected one."""
    mined = template_of(raw_line)
    return F.struct(mined.alias("template"), template.eqNullSafe(mined).alias("is_correct"))


def refine_template(raw_line: Column, parser: Column, critic: Column) -> Column:
    """The critic's template if right, else the parser's, else one mined from the line."""
    mined = template_of(raw_line)
    chosen = (
        F.when(critic.eqNullSafe(mined), "critic")
        .when(parser.eqNullSafe(mined), "parser")
        .otherwise("mined")
    )
    return F.struct(mined.alias("template"), chosen.alias("chosen"))


def template_counts(lines: DataFrame, value: str = "raw_line") -> DataFrame:
    """How often each template occurs and where it is seen first."""
    return (
        lines.select("line_no", template_of(F.col(value)).alias("template"))
        .groupBy("template")
        .agg(F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"))
    )
