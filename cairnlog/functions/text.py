"""Short text helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def preview(text: Column, chars: int = 500) -> Column:
    """The first ``chars`` characters, with dots when something was cut."""
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def mentions(lower_text: Column, words: Sequence[str]) -> Column:
    """Whether a lower-case text contains any of the words; far cheaper than a pattern."""
    return reduce(lambda a, b: a | b, (lower_text.contains(word) for word in words))


def line_span(start: Column, end: Column) -> Column:
    """``start-end``."""
    return F.concat_ws("-", start.cast("string"), end.cast("string"))


def truncate_notice(text: Column, limit: int) -> Column:
    """Cut at ``limit`` with a note of the full length; ``limit`` <= 0 leaves the text."""
    if limit <= 0:
        return text
    # Fixed value: the wording of the note.
    note = F.format_string(
        f"...[truncated]. This content was truncated at {limit} characters. "
        "Full output length: %d characters.",
        F.length(text),
    )
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), note)
    ).otherwise(text)


# Shortened parts of configuration names, applied in this order.
NAME_PARTS = (
    ("baseline_", ""),
    ("evaluator_", "eval_"),
    ("_with_preprocessing", "+prep"),
    ("_no_preprocessing", ""),
)


def display_name(name: Column) -> Column:
    """A configuration name as shown in charts."""
    for part, short in NAME_PARTS:
        name = F.replace(name, F.lit(part), F.lit(short))
    return name


def redact_config(config: Column) -> Column:
    """Hide the values of keys that mention an API key."""
    return F.transform_values(
        config,
        lambda key, value: F.when(F.lower(key).contains("api_key"), F.lit("[REDACTED]")).otherwise(
            value
        ),
    )


def round_half_even(number: Column, digits: int) -> Column:
    """Round to ``digits`` with ties to even."""
    scale = float(10**digits)
    return F.rint(number * scale) / scale
