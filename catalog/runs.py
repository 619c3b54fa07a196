"""Run logs: timelines, summaries, tokens, tools and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlog.operators import runs as ops

from . import register
from .views import sql

_TOTAL = "sessions AS (SELECT session_id, CAST(sum(length(message)) AS double) / 100 AS duration FROM v_sessions GROUP BY 1)"
_CALLS = """calls AS (SELECT session_id, interaction_no, iteration_no, concat('tool', CAST(length(line) % 4 AS varchar)) AS name,
    concat(session_id, '-', CAST(interaction_no AS varchar), '-', CAST(iteration_no AS varchar)) AS id,
    CASE WHEN length(line) % 3 <> 0 THEN line[1:5] END AS result FROM iter_lines WHERE length(line) > 20)"""
_WHOLE = """inter AS (SELECT v.*, s.duration AS run_duration, len(string_split(message, chr(10))) AS n_iterations,
    len(list_filter(string_split(message, chr(10)), lambda x: length(x) > 20)) AS total_tool_calls
  FROM v_sessions v JOIN sessions s USING (session_id))"""


def _sql(body: str) -> str:
    return sql("SELECT 1", "v_sessions", "iter_lines").replace(
        "\nSELECT 1", ",\n" + ",\n".join((_TOTAL, _CALLS, _WHOLE)) + "\n" + body
    )


register(
    "d5_tool_call_results",
    lambda t: ops.tool_call_results(
        ops.tool_calls_table(t.iterations()), ops.tool_results_table(t.iterations())
    ),
    _sql("SELECT * FROM calls"),
)
register(
    "d6_run_tree",
    lambda t: ops.run_tree(t.interactions()),
    sql(
        """SELECT session_id, interaction_no, agent, CAST(len(string_split(path, ' > ')) - 1 AS INTEGER) AS depth, path FROM (
        SELECT i.session_id, i.interaction_no, i.agent, concat(coalesce(t.path || ' > ', ''), i.agent) AS path
        FROM v_sessions i JOIN (
          SELECT session_id, NULL AS agent, NULL AS path FROM v_sessions GROUP BY session_id
          UNION ALL SELECT session_id, agent, path FROM tree WHERE NOT seen) t
        ON i.session_id = t.session_id AND i.parent IS NOT DISTINCT FROM t.agent)""",
        "v_sessions",
    )
    .replace("WITH v_sessions", "WITH RECURSIVE v_sessions")
    .replace(
        "\nSELECT session_id, interaction_no",
        """,\nedges AS (SELECT DISTINCT session_id, parent, agent FROM v_sessions),
        tree AS (SELECT session_id, agent, agent AS path, false AS seen FROM edges WHERE parent IS NULL
          UNION SELECT e.session_id, e.agent, concat(t.path, ' > ', e.agent),
            list_contains(string_split(t.path, ' > '), e.agent)
          FROM tree t JOIN edges e ON e.session_id = t.session_id AND e.parent = t.agent WHERE NOT t.seen)
        SELECT session_id, interaction_no""",
        1,
    ),
)
register(
    "e23_token_usage",
    lambda t: ops.token_usage(t.iterations()),
    _sql(
        """SELECT session_id, CAST(sum(length(line)) AS BIGINT) AS input_tokens, CAST(sum(length(line) % 7) AS BIGINT) AS output_tokens,
        CAST(sum(length(line) + length(line) % 7) AS BIGINT) AS total_tokens FROM iter_lines GROUP BY session_id"""
    ),
)
register(
    "e26_tool_usage",
    lambda t: ops.tool_usage(ops.tool_calls_table(t.iterations())),
    _sql("SELECT name, count(*) AS count FROM calls GROUP BY name"),
)
register(
    "t1_run_timeline",
    lambda t: ops.run_timeline(t.interactions()),
    _sql(
        """SELECT session_id, interaction_no, agent, parent, start_time, duration, s AS bar_start,
        CASE WHEN s IS NULL THEN 0 ELSE greatest(0, least(s + greatest(1, l), 50) - s) END AS bar_length FROM (
          SELECT *, CASE WHEN run_duration <> 0 THEN CAST(trunc(start_time / run_duration * 50) AS INTEGER) END AS s,
            CASE WHEN run_duration <> 0 THEN CAST(trunc(duration / run_duration * 50) AS INTEGER) END AS l FROM inter)"""
    ),
)
register(
    "t2_run_iterations",
    lambda t: ops.run_iterations(t.iterations()),
    _sql(
        """SELECT session_id, interaction_no, iteration_no, iteration_no + 1 AS iteration, start_time + iteration_no AS "timestamp",
        CASE WHEN length(line) > 20 THEN concat('tool', CAST(length(line) % 4 AS varchar)) ELSE '(response)' END AS tools,
        iteration_no = n_iterations - 1 AS is_last FROM iter_lines"""
    ),
)
register(
    "t3_run_summary",
    lambda t: ops.run_summary(t.sessions(), t.interactions()),
    _sql(
        """SELECT session_id, any_value(run_duration) AS duration, count(*) AS interactions,
        CAST(sum(n_iterations) AS BIGINT) AS iterations, CAST(sum(total_tool_calls) AS BIGINT) AS tool_calls FROM inter GROUP BY session_id"""
    ),
)
register(
    "t4_last_iteration_tokens",
    lambda t: ops.last_iteration_tokens(t.interactions(), t.iterations()),
    _sql(
        """SELECT session_id, length(line) AS input_tokens, length(line) % 7 AS output_tokens, length(line) + length(line) % 7 AS total_tokens
        FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY interaction_no DESC, iteration_no DESC) AS r FROM iter_lines) WHERE r = 1"""
    ),
)
register(
    "t5_agent_breakdown",
    lambda t: ops.agent_breakdown(t.interactions()),
    _sql("SELECT session_id, interaction_no, agent, n_iterations, total_tool_calls, duration FROM inter"),
)
register(
    "t6_newest_runs",
    lambda t: ops.newest_runs(t.sessions()).withColumn("duration", F.round("duration", 6)),
    _sql("SELECT session_id, round(duration, 6) AS duration FROM sessions ORDER BY session_id DESC"),
)
