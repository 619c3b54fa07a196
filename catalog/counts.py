"""Log statistics and the questions made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlog.operators import stats as ops
from cairnlog.operators.questions import generate_questions

from . import register
from .views import sql


def _counts(key: str, where: str = "", limit: str = "") -> str:
    return f"""SELECT {key}, count(*) AS count, min(line_no) AS first_line FROM ph {where}
      GROUP BY {key} {limit}"""


_TOP = "ORDER BY count DESC, first_line LIMIT 10"
_ARG = "SELECT {key} AS {name} FROM ({counts}) ORDER BY {order}, first_line LIMIT 1"
_HOURS = """SELECT hour, count(*) FILTER (level = 'ERROR') AS errors, count(*) AS count,
  min(line_no) AS first_line FROM ph WHERE hour IS NOT NULL GROUP BY hour"""
_PATTERNS = r"""SELECT pattern, count(*) AS count, min(line_no) AS first_line FROM (
    SELECT line_no, array_to_string(words[1:5], ' ') AS pattern FROM (
      SELECT line_no, string_split_regex(lower(message), '\s+') AS words FROM ph WHERE level = 'ERROR')
    WHERE len(words) >= 3) GROUP BY pattern"""


def _arg(key: str, name: str, counts: str, order: str) -> str:
    return _ARG.format(key=key, name=name, counts=counts, order=order)


register(
    "e4_total_lines",
    lambda t: ops.total_lines(t.parsed()),
    sql("SELECT count(*) AS total_lines FROM p", "p"),
)
register("e5_level_counts", lambda t: ops.level_counts(t.parsed()), sql(_counts("level"), "ph"))
register(
    "e6_component_counts",
    lambda t: ops.component_counts(t.parsed()),
    sql(_counts("component", limit=_TOP), "ph"),
)
register(
    "e7_node_counts",
    lambda t: ops.node_counts(t.parsed()),
    sql(_counts("node_id", limit=_TOP), "ph"),
)
register(
    "e8_hour_counts",
    lambda t: ops.hour_counts(t.parsed()),
    sql(_counts("hour", "WHERE hour IS NOT NULL"), "ph"),
)
register(
    "e9_hour_level_counts",
    lambda t: ops.hour_level_counts(t.parsed()),
    sql(_counts("hour, level", "WHERE hour IS NOT NULL"), "ph"),
)
register(
    "e9_hour_level_map",
    lambda t: ops.hour_level_map(t.parsed()).select(
        "hour", F.to_json(F.array_sort(F.map_entries("levels"))).alias("levels")
    ),
    sql(
        """SELECT hour, concat('[', string_agg(concat('{"key":"', level, '","value":', CAST(n AS varchar), '}'), ',' ORDER BY level), ']') AS levels
        FROM (SELECT hour, level, count(*) AS n FROM ph WHERE hour IS NOT NULL GROUP BY 1, 2) GROUP BY hour""",
        "ph",
    ),
)
register(
    "e10_error_patterns",
    lambda t: ops.error_patterns(t.parsed()),
    sql(_PATTERNS + " " + _TOP, "ph"),
)
register(
    "e11_peak_error_hour",
    lambda t: ops.peak_error_hour(t.parsed()),
    sql(_arg("hour", "peak_error_hour", _HOURS, "errors DESC"), "ph"),
)
register(
    "e12_time_span",
    lambda t: ops.time_span(t.parsed()),
    sql('SELECT arg_min("timestamp", line_no) AS "start", arg_max("timestamp", line_no) AS "end" FROM p', "p"),
)
register(
    "e13_unique_counts",
    lambda t: ops.unique_counts(t.parsed()),
    sql(
        "SELECT count(DISTINCT node_id) AS unique_nodes, count(DISTINCT component) AS unique_components FROM p",
        "p",
    ),
)
register(
    "e14_busiest_hour",
    lambda t: ops.busiest_hour(t.parsed()),
    sql(_arg("hour", "busiest_hour", _HOURS, "count DESC"), "ph"),
)
register(
    "e14_quietest_hour",
    lambda t: ops.quietest_hour(t.parsed()),
    sql(_arg("hour", "quietest_hour", _HOURS, "count"), "ph"),
)
register(
    "e15_busiest_node",
    lambda t: ops.busiest_node(t.parsed()),
    sql(_arg("node_id", "busiest_node", _counts("node_id"), "count DESC"), "ph"),
)
register(
    "e16_hours_with_errors",
    lambda t: ops.hours_with_errors(t.parsed()),
    sql(f"SELECT hour, errors FROM ({_HOURS}) WHERE errors > 0", "ph"),
)
register(
    "e17_component_error_counts",
    lambda t: ops.component_error_counts(t.parsed()),
    sql(_counts("component", "WHERE level = 'ERROR'", _TOP), "ph"),
)
register(
    "e17_component_with_most_errors",
    lambda t: ops.component_with_most_errors(t.parsed()),
    sql(
        _arg(
            "component",
            "component_with_most_errors",
            _counts("component", "WHERE level = 'ERROR'"),
            "count DESC",
        ),
        "ph",
    ),
)
register(
    "e18_info_warning_counts",
    lambda t: ops.info_warning_counts(t.parsed()),
    sql(
        """SELECT count(*) FILTER (level = 'INFO') AS info_count,
        count(*) FILTER (level = 'WARNING') AS warning_count FROM p""",
        "p",
    ),
)
register(
    "e19_error_ratio",
    lambda t: ops.error_ratio(t.parsed()),
    sql(
        """SELECT CAST(round_even(count(*) FILTER (level = 'ERROR') / count(*) * 100, 0) AS BIGINT)
        AS error_ratio FROM p""",
        "p",
    ),
)
register(
    "e20_info_error_ratio",
    lambda t: ops.info_error_ratio(t.parsed()),
    sql(
        """SELECT CAST(round_even(count(*) FILTER (level = 'INFO') / count(*) FILTER (level = 'ERROR'), 0)
        AS BIGINT) AS info_error_ratio FROM p""",
        "p",
    ),
)

_FACTS = f"""facts AS (SELECT count(*) AS total, count(*) FILTER (level = 'ERROR') AS err,
    count(*) FILTER (level = 'WARNING') AS warn, count(*) FILTER (level = 'INFO') AS info,
    count(*) FILTER (level = 'FATAL') AS fatal, count(DISTINCT node_id) AS nodes,
    count(DISTINCT component) AS comps,
    (SELECT array_to_string(list(level ORDER BY f), '|') FROM (SELECT level, min(line_no) AS f FROM ph GROUP BY level)) AS levels,
    (SELECT array_to_string(list(component ORDER BY count DESC, first_line), '|') FROM ({_counts("component")} ORDER BY count DESC, first_line LIMIT 3)) AS top3,
    ({_arg("component", "x", _counts("component"), "count DESC")}) AS top,
    ({_arg("hour", "x", _HOURS, "errors DESC")}) AS peak,
    ({_arg("hour", "x", _HOURS, "count DESC")}) AS busy,
    ({_arg("hour", "x", _HOURS, "count")}) AS quiet,
    ({_arg("node_id", "x", _counts("node_id"), "count DESC")}) AS node,
    ({_arg("component", "x", _counts("component", "WHERE level = 'ERROR'"), "count DESC")}) AS bad,
    (SELECT count(*) FROM ({_HOURS}) WHERE errors > 0) AS bad_hours
    FROM ph)"""

# id, type, expected number, expected texts joined by "|", tolerance, emitted when
_QUESTIONS = [
    ("q1_error_count", "integer", "err", None, 0, "true"),
    ("q2_total_lines", "integer", "total", None, 0, "true"),
    ("q3_top_component", "string_match", None, "top", None, "comps > 0"),
    ("q4_top3_components", "list", None, "top3", None, "comps >= 3"),
    ("q5_peak_error_hour", "string_match", None, "concat(peak, '|hour ', peak, '|', peak, ':00')", None, "peak IS NOT NULL"),
    ("q6_warning_count", "integer", "warn", None, 0, "warn > 0"),
    ("q7_level_types", "list", None, "levels", None, "true"),
    ("q8_error_ratio", "integer", "round_even(err / total * 100, 0)", None, 2, "total > 0"),
    ("q9_unique_nodes", "integer", "nodes", None, 0, "true"),
    ("q10_busiest_node", "string_match", None, "node", None, "node IS NOT NULL"),
    ("q11_has_fatal", "string_match", None, "CASE WHEN fatal > 0 THEN 'yes|true|1' ELSE 'no|false|0' END", None, "true"),
    ("q12_component_most_errors", "string_match", None, "bad", None, "bad IS NOT NULL"),
    ("q13_info_error_ratio", "integer", "round_even(info / err, 0)", None, 1, "info > 0 AND err > 0"),
    ("q14_info_vs_warning", "string_match", None, "CASE WHEN info > warn THEN 'INFO|info' ELSE 'WARNING|warning' END", None, "info > 0 AND warn > 0"),
    ("q15_quietest_hour", "string_match", None, "concat(quiet, '|hour ', quiet, '|', quiet, ':00')", None, "quiet IS NOT NULL"),
    ("q16_busiest_hour", "string_match", None, "concat(busy, '|hour ', busy, '|', busy, ':00')", None, "busy IS NOT NULL"),
    ("q17_nodes_vs_components", "string_match", None, "CASE WHEN nodes > comps THEN 'nodes' ELSE 'components' END", None, "nodes > 0 AND comps > 0"),
    ("q18_hours_with_errors", "integer", "bad_hours", None, 0, "bad_hours > 0"),
]
_QUESTION_SQL = " UNION ALL ".join(
    f"""SELECT '{i}' AS id, '{kind}' AS answer_type, CAST({number or 'NULL'} AS BIGINT) AS expected_int,
      {texts or 'CAST(NULL AS varchar)'} AS expected_texts,
      CAST({'NULL' if tolerance is None else tolerance} AS INTEGER) AS tolerance
      FROM facts WHERE {emit}"""
    for i, kind, number, texts, tolerance, emit in _QUESTIONS
)
register(
    "e21_generate_questions",
    lambda t: generate_questions(ops.log_facts(t.parsed())).select(
        "id",
        "answer_type",
        "expected_int",
        F.array_join("expected_list", "|").alias("expected_texts"),
        "tolerance",
    ),
    sql("SELECT 1", "ph").replace("\nSELECT 1", ",\n" + _FACTS + "\n" + _QUESTION_SQL),
)


def _section(name: str, key: str, body: str, subkey: str = "NULL", value: str = "count") -> str:
    return f"""SELECT '{name}' AS section, {key} AS key, CAST({subkey} AS varchar) AS subkey,
      CAST({value} AS varchar) AS value FROM ({body})"""


_SPAN = 'SELECT arg_min("timestamp", line_no) AS a, arg_max("timestamp", line_no) AS b FROM p'
_FACT_NAMES = {
    "total_lines": "total", "error_count": "err", "info_count": "info", "warning_count": "warn",
    "unique_nodes": "nodes", "unique_components": "comps", "peak_error_hour": "peak",
    "busiest_hour": "busy", "quietest_hour": "quiet", "busiest_node": "node",
    "component_with_most_errors": "bad",
}
_STATISTICS = " UNION ALL ".join(
    [
        _section("level_counts", "level", _counts("level")),
        _section("component_counts", "component", _counts("component", limit=_TOP)),
        _section("node_counts", "node_id", _counts("node_id", limit=_TOP)),
        _section("hour_counts", "hour", _HOURS),
        _section("hour_level_counts", "hour", _counts("hour, level", "WHERE hour IS NOT NULL"), "level"),
        _section("error_patterns", "pattern", _PATTERNS + " " + _TOP),
        _section("component_error_counts", "component", _counts("component", "WHERE level = 'ERROR'", _TOP)),
        _section("hours_with_errors", "hour", f"{_HOURS} HAVING errors > 0", value="errors"),
        _section("time_span", "'start'", _SPAN, value="a"),
        _section("time_span", "'end'", _SPAN, value="b"),
        *(_section("facts", f"'{n}'", "SELECT * FROM facts", value=c) for n, c in _FACT_NAMES.items()),
    ]
)
register(
    "a16_statistics_rows",
    lambda t: ops.statistics_rows(t.parsed()),
    sql("SELECT 1", "ph").replace("\nSELECT 1", ",\n" + _FACTS + "\n" + _STATISTICS),
)
