"""Text-table operators on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.operators import lines as ops

from . import register
from .views import Tables, sql


def _lines(t: Tables) -> DataFrame:
    return t.doc_lines()


def _log_file(t: Tables) -> DataFrame:
    return t.view("v_mixed").select(
        F.lit("mixed").alias("file"),
        "line_no",
        F.regexp_extract("value", r"(\S+)$", 1).alias("value"),
    )


def _block_file(t: Tables) -> DataFrame:
    return t.view("v_hdfs").select(
        F.lit("blocks").alias("file"), "line_no", F.regexp_extract("raw_line", r"blk_\d+", 0).alias("value")
    )


_MIXED = r"mixed AS (SELECT 'mixed' AS file, line_no, regexp_extract(value, '(\S+)$', 1) AS value FROM v_mixed)"
_BLOCKS = r"blocks_file AS (SELECT 'blocks' AS file, line_no, regexp_extract(raw_line, 'blk_\d+') AS value FROM v_hdfs)"


def _sql(body: str) -> str:
    return sql("SELECT 1", "v_mixed", "v_hdfs", "doc_lines").replace(
        "\nSELECT 1", f",\n{_MIXED},\n{_BLOCKS}\n{body}"
    )


register(
    "u1_grep",
    lambda t: ops.grep(_lines(t), r"^[A-Z][a-z]+ the\b", ignore_case=True),
    _sql(r"SELECT * FROM doc_lines WHERE regexp_matches(value, '(?i)^[A-Z][a-z]+ the\b')"),
)
register(
    "u1_grep_invert",
    lambda t: ops.grep(_lines(t), r"[a-z]", invert=True),
    _sql("SELECT * FROM doc_lines WHERE NOT regexp_matches(value, '[a-z]')"),
)
register(
    "u2_grep_count",
    lambda t: ops.grep_count(_lines(t), "the"),
    _sql("SELECT file, count(*) FILTER (contains(value, 'the')) AS count FROM doc_lines GROUP BY file"),
)
register(
    "u3_wc",
    lambda t: ops.wc(_lines(t)),
    _sql(
        r"""SELECT file, count(*) AS lines, CAST(sum(len(regexp_extract_all(value, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))) AS BIGINT) AS words,
        CAST(sum(length(value) + 1) AS BIGINT) AS chars FROM doc_lines GROUP BY file"""
    ),
)
register(
    "u4_cut",
    lambda t: ops.cut(_lines(t), " ", [1, 3]),
    _sql(
        """SELECT file, line_no, p[1] AS f1, p[3] AS f3 FROM (
        SELECT file, line_no, string_split(value, ' ') AS p FROM doc_lines)"""
    ),
)
register(
    "u5_sort_lines",
    lambda t: ops.sort_lines(_lines(t), descending=True),
    _sql("SELECT * FROM doc_lines ORDER BY value DESC, file, line_no"),
)
register(
    "u5_sort_lines_numeric",
    lambda t: ops.sort_lines(_block_file(t), F.substring("value", 5, 20), numeric=True),
    _sql("SELECT * FROM blocks_file ORDER BY CAST(value[5:] AS double), line_no"),
)
register(
    "u6_uniq_adjacent",
    lambda t: ops.uniq_adjacent(_log_file(t), 1000),
    _sql(
        """SELECT file, line_no, value FROM (SELECT *, lag(value) OVER (ORDER BY line_no) AS b FROM mixed)
        WHERE b IS DISTINCT FROM value"""
    ),
)
register(
    "u7_value_counts",
    lambda t: ops.value_counts(_lines(t), 10),
    _sql("SELECT value, count(*) AS count FROM doc_lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
)
register(
    "u8_head",
    lambda t: ops.head(_lines(t), 3),
    _sql("SELECT * FROM doc_lines WHERE line_no <= 3"),
)
register(
    "u8_tail",
    lambda t: ops.tail(_lines(t), 3),
    _sql(
        """SELECT file, line_no, value FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS r
        FROM doc_lines) WHERE r <= 3"""
    ),
)
register(
    "u9_substitute",
    lambda t: ops.substitute(_lines(t), "[aeiou]+", "_"),
    _sql("SELECT file, line_no, regexp_replace(value, '[aeiou]+', '_', 'g') AS value FROM doc_lines"),
)
register(
    "u9_translate",
    lambda t: ops.translate(_lines(t), "aet", "43"),
    _sql("SELECT file, line_no, replace(replace(replace(value, 'a', '4'), 'e', '3'), 't', '') AS value FROM doc_lines"),
)


def _joined(t: Tables) -> DataFrame:
    left = _block_file(t).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    right = _block_file(t).select("value", "line_no")
    return ops.join_fields(right, left, "value")


register(
    "u10_join_fields",
    _joined,
    _sql(
        """SELECT value, line_no, n FROM blocks_file JOIN (SELECT value, count(*) AS n FROM blocks_file GROUP BY value)
        USING (value)"""
    ),
)


def _half(t: Tables, rest: int) -> DataFrame:
    """The words of every third line, or of the others. Many are in both, some in one only."""
    third = F.col("line_no") % 3 == 0
    words = F.explode(F.split("value", " ")).alias("value")
    return _log_file(t).where(~third if rest else third).select("file", "line_no", words)


_HALF = """SELECT unnest(string_split(value, ' ')) AS value FROM mixed WHERE (line_no % 3 <> 0) = ({0} = 1)"""
for _name, _run, _set in (
    ("u11_common_lines", ops.common_lines, f"{_HALF.format(0)} INTERSECT ALL {_HALF.format(1)}"),
    ("u11_only_left", ops.only_left, f"{_HALF.format(0)} EXCEPT ALL {_HALF.format(1)}"),
    ("u11_only_right", ops.only_right, f"{_HALF.format(1)} EXCEPT ALL {_HALF.format(0)}"),
):
    register(_name, lambda t, run=_run: run(_half(t, 0), _half(t, 1)), _sql(_set))

register(
    "u12_paste",
    lambda t: ops.paste(_log_file(t), ops.grep(_block_file(t), "0$")),
    _sql(
        """SELECT line_no, concat(coalesce(a.value, ''), chr(9), coalesce(b.value, '')) AS value FROM mixed a
        FULL JOIN (SELECT * FROM blocks_file WHERE value LIKE '%0') b USING (line_no)"""
    ),
)
register(
    "u13_union_files",
    lambda t: ops.union_files(_log_file(t), _block_file(t), _lines(t)),
    _sql(
        """SELECT * FROM mixed UNION ALL SELECT * FROM blocks_file UNION ALL SELECT file, line_no, value FROM doc_lines"""
    ),
)
