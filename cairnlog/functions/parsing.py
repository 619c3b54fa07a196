"""Line parsers as column expressions.

Every parser returns a nullable ``struct`` of strings. A line that does not fit gives
null.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

RECORD_TYPE = "timestamp string, level string, component string, message string"

# The line formats.
OPENSTACK_LINE = (
    r"(?Us)^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\w+)\s+([\w.]+).*\]\s+(.*)$"
)
BLOCK_LOG_HEADER = r"^\d{6}\s+\d{6}(\s+\d+)?\s+[A-Z]+\s+\S+:\s+"
BLOCK_LOG_LINE = r"(?s)^(\d{6})\s+(\d{6})(?:\s+\d+)?\s+([A-Z]+)\s+(\S+):\s+(.*)$"
BLOCK_ID = r"blk_-?\d+"
FORMATS = ("openstack", "bgl", "generic")

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a class; the Unicode flag is far faster than listing them.
_BLANK = r"(?U)[\s\x1c-\x1f]+"
_MARK = "\x01"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def fields(line: Column, limit: int = -1) -> Column:
    """The line cut at white space into at most ``limit`` parts; the last keeps its blanks."""
    return F.split(strip(line), _BLANK, limit)


def _record(timestamp: Column, level: Column, component: Column, message: Column) -> Column:
    return F.struct(
        timestamp.alias("timestamp"),
        level.alias("level"),
        component.alias("component"),
        message.alias("message"),
    )


def parse_openstack(line: Column) -> Column:
    """Date-time, level, component and the text after the last ``] ``."""
    # One rewrite marks the four groups, so the pattern is not run once per group.
    marked = F.regexp_replace(line, OPENSTACK_LINE, _MARK.join(("$1", "$2", "$3", "$4")))

    def record(part: Column) -> Column:
        return _record(*(F.try_element_at(part, F.lit(i)) for i in (1, 2, 3, 4)))

    return F.when(line.rlike(OPENSTACK_LINE), let(F.split(marked, _MARK, 4), record))


def parse_bgl(line: Column) -> Column:
    """Ten blank-separated fields; the last keeps its blanks."""

    def record(part: Column) -> Column:
        return F.when(F.size(part) >= 10, _record(part[4], part[8], part[7], part[9]))

    return let(fields(line, 10), record)


def bgl_node_record(part: Column) -> Column:
    """The record of ten ``fields``."""
    return F.struct(
        part[4].alias("timestamp"),
        part[5].alias("node_id"),
        part[8].alias("level"),
        part[7].alias("component"),
        part[9].alias("message"),
    )


def parse_bgl_node(line: Column) -> Column:
    """As ``parse_bgl`` with the node as well."""

    def record(part: Column) -> Column:
        return F.when(F.size(part) >= 10, bgl_node_record(part))

    return let(fields(line, 10), record)


def parse_generic(line: Column) -> Column:
    """Timestamp, level and the rest of the line."""

    def record(part: Column) -> Column:
        rest = F.coalesce(F.try_element_at(part, F.lit(3)), F.lit(""))
        return F.when(F.size(part) >= 2, _record(part[0], part[1], F.lit(""), rest))

    return let(fields(line, 3), record)


def parse_block_log(line: Column) -> Column:
    """Lines with the block log header: date and time, level, class and message."""

    def part(place: int) -> Column:
        return F.regexp_extract(line, BLOCK_LOG_LINE, place)

    stamp = F.concat_ws(" ", part(1), part(2))
    return F.when(line.rlike(BLOCK_LOG_LINE), _record(stamp, part(3), part(4), part(5)))


PARSERS: dict[str, Callable[[Column], Column]] = {
    "openstack": parse_openstack,
    "bgl": parse_bgl,
    "generic": parse_generic,
    "hdfs": parse_block_log,
}


def parse_auto(line: Column) -> Column:
    """The first parser that accepts the line."""
    return F.coalesce(*(PARSERS[name](line) for name in FORMATS))


def line_format(line: Column) -> Column:
    """Name of the first format that accepts the line; ``generic`` if none does."""
    return (
        F.when(line.rlike(OPENSTACK_LINE), "openstack")
        .when(F.size(fields(line, 10)) >= 10, "bgl")
        .otherwise("generic")
    )


def parse_as(format_name: Column, line: Column) -> Column:
    """Parse each line by the format named beside it."""
    return (
        F.when(format_name == "openstack", parse_openstack(line))
        .when(format_name == "bgl", parse_bgl(line))
        .otherwise(parse_generic(line))
    )


def parse_with(parser: Callable[[str], dict | None]) -> Callable[[Column], Column]:
    """Wrap a user's ``line -> record or None`` as an Arrow-batched column function."""

    @F.pandas_udf(RECORD_TYPE)
    def parsed(lines: pd.Series) -> pd.DataFrame:
        names = ["timestamp", "level", "component", "message"]
        rows = []
        for line in lines:
            found = None if line is None else parser(line)
            rows.append(
                [None] * 4 if not found else [str(found.get(name) or "") for name in names]
            )
        return pd.DataFrame(rows, columns=names, dtype=object)

    def apply(line: Column) -> Column:
        record = parsed(line)
        # A user record has all fields set, so one null field means "not parsed".
        return F.when(record["timestamp"].isNotNull(), record)

    return apply


def message_body(line: Column) -> Column:
    """The line without a block-log header (date, time, process, level, class)."""
    return F.regexp_replace(line, BLOCK_LOG_HEADER, "")


def block_id(line: Column) -> Column:
    """The first block id in the line, null when there is none."""
    return let(F.regexp_extract(line, BLOCK_ID, 0), lambda found: F.when(found != "", found))


# Variable token shapes; a closing punctuation mark is kept.
_TOKEN_END = r"([.,;:)]?)$"
TOKEN_ADDRESS = r"^/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+" + _TOKEN_END
TOKEN_VARIABLE = (
    r"^(/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|blk_-?\d+|-?\d+(\.\d+)?|0x[0-9a-fA-F]+|/[^ ]+?)"
    + _TOKEN_END
)


def mine_template(body: Column) -> Column:
    """The body with every variable token replaced by ``<*>``."""

    def shape(token: Column) -> Column:
        return F.when(
            token.rlike(TOKEN_ADDRESS),
            F.concat(F.lit("<*>:<*>"), F.regexp_extract(token, TOKEN_ADDRESS, 1)),
        ).when(
            token.rlike(TOKEN_VARIABLE),
            F.concat(F.lit("<*>"), F.regexp_extract(token, TOKEN_VARIABLE, 3)),
        ).otherwise(token)

    return F.array_join(F.transform(F.split(body, " "), shape), " ")


def hour_of(timestamp: Column) -> Column:
    """Hour text of ``yyyy-MM-dd-HH.mm...``; null when the text has another shape."""
    fourth = F.try_element_at(F.split(timestamp, "-"), F.lit(4))
    return F.substring_index(fourth, ".", 1)
