"""Templates, block sessions, labels and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.functions.parsing import block_id, message_body
from cairnlog.operators import sessions as ops
from cairnlog.operators import templates

from . import register
from .views import Tables, sql

_END = r"([.,;:)]?)$"
_ADDRESS = r"^/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}:\d+" + _END
_VARIABLE = (
    r"^(/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|blk_-?\d+|-?\d+(\.\d+)?|0x[0-9a-fA-F]+|/[^ ]+?)" + _END
)
_MINED = f"""array_to_string(list_transform(string_split(body, ' '), lambda w:
  CASE WHEN regexp_matches(w, '{_ADDRESS}') THEN concat('<*>:<*>', regexp_extract(w, '{_ADDRESS}', 1))
  WHEN regexp_matches(w, '{_VARIABLE}') THEN concat('<*>', regexp_extract(w, '{_VARIABLE}', 3))
  ELSE w END), ' ')"""

def _raw():
    return F.col("raw_line")


def _hdfs(t: Tables) -> DataFrame:
    return t.view("v_hdfs")


register(
    "b8_message_body",
    lambda t: _hdfs(t).select("line_no", message_body(_raw()).alias("body")),
    sql("SELECT line_no, body FROM blocks", "blocks"),
)
register(
    "b9_mine_template",
    lambda t: _hdfs(t).select("line_no", templates.template_of(_raw()).alias("template")),
    sql(f"SELECT line_no, {_MINED} AS template FROM blocks", "blocks"),
)

def _given():
    mined = templates.template_of(_raw())
    return F.when(F.col("line_no") % 2 == 0, mined).otherwise(message_body(_raw()))


register(
    "b10_check_template",
    lambda t: _hdfs(t)
    .select("line_no", templates.check_template(_raw(), _given()).alias("c"))
    .select("line_no", "c.*"),
    sql(
        f"""SELECT line_no, mined AS template, CASE WHEN line_no % 2 = 0 THEN true ELSE body = mined END AS is_correct
        FROM (SELECT line_no, body, {_MINED} AS mined FROM blocks)""",
        "blocks",
    ),
)
def _critic():
    mined = templates.template_of(_raw())
    return F.when(F.col("line_no") % 3 == 0, mined).otherwise(F.lit("other"))


register(
    "b11_refine_template",
    lambda t: _hdfs(t)
    .select("line_no", templates.refine_template(_raw(), _given(), _critic()).alias("r"))
    .select("line_no", "r.*"),
    sql(
        f"""SELECT line_no, mined AS template, CASE WHEN line_no % 3 = 0 THEN 'critic'
          WHEN line_no % 2 = 0 OR body = mined THEN 'parser' ELSE 'mined' END AS chosen
        FROM (SELECT line_no, body, {_MINED} AS mined FROM blocks)""",
        "blocks",
    ),
)
register(
    "b12_template_counts",
    lambda t: templates.template_counts(_hdfs(t)),
    sql(
        f"""SELECT template, count(*) AS count, min(line_no) AS first_line
        FROM (SELECT line_no, {_MINED} AS template FROM blocks) GROUP BY template""",
        "blocks",
    ),
)

register(
    "s1_extract_sessions",
    lambda t: ops.extract_sessions(_hdfs(t)).select(
        "session_id", F.col("event_no").cast("long"), "line_no", "raw_line", "first_line", "n_events"
    ),
    sql(
        """SELECT session_id, row_number() OVER w AS event_no, line_no, raw_line,
        min(line_no) OVER (PARTITION BY session_id) AS first_line,
        count(*) OVER (PARTITION BY session_id) AS n_events
        FROM blocks WINDOW w AS (PARTITION BY session_id ORDER BY line_no)""",
        "blocks",
    ),
)
register(
    "s2_first_sessions",
    lambda t: ops.first_sessions(_hdfs(t), 10).select("session_id", "line_no", "raw_line"),
    sql(
        """SELECT session_id, line_no, raw_line FROM blocks WHERE session_id IN
        (SELECT session_id FROM blocks GROUP BY 1 ORDER BY min(line_no) LIMIT 10)""",
        "blocks",
    ),
)
register(
    "s3_format_sessions",
    lambda t: ops.format_sessions(ops.extract_sessions(_hdfs(t))).select(
        "session_id", F.col("row_no").cast("long"), "text"
    ),
    sql(
        """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS row_no,
        raw_line AS text FROM blocks
        UNION ALL SELECT session_id, 0 AS row_no, concat('=== Block Session: ', session_id,
        ' (', CAST(count(*) AS varchar), ' events) ===') AS text FROM blocks GROUP BY session_id""",
        "blocks",
    ),
)


def _labels(t: Tables) -> DataFrame:
    return t.table("labels").select(
        F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("block_id"),
        F.col("toxic").alias("label"),
    )


register(
    "s4_balanced_sample",
    lambda t: ops.balanced_sample(_labels(t), 30),
    """SELECT block_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label
        ORDER BY md5(concat('42:', block_id)), block_id) AS place
      FROM (SELECT concat('blk_', CAST(doc_id AS varchar)) AS block_id, toxic AS label FROM labels))
    WHERE place <= 15""",
)
_WORDS = ("error", "fail", "exception", "crash", "interrupt", "fatal")
register(
    "s5_textual_signals",
    lambda t: ops.textual_signals(_hdfs(t)).withColumn("words", F.array_join("words", ",")),
    sql(
        f"""SELECT session_id, count(*) FILTER (regexp_matches(body, '(?i){"|".join(_WORDS)}')) AS failure_lines,
        concat_ws(',', {", ".join(f"CASE WHEN bool_or(contains(lower(body), '{w}')) THEN '{w}' END" for w in _WORDS)}) AS words
        FROM blocks GROUP BY session_id""",
        "blocks",
    ),
)
register(
    "s6_lifecycle_features",
    lambda t: ops.lifecycle_features(_hdfs(t)),
    sql("SELECT * FROM features", "features"),
)


def _behaviour(t: Tables) -> DataFrame:
    return ops.with_behaviour(ops.lifecycle_features(_hdfs(t)))


_FLAGS = ["missing_storage", "unfinished", "repeated_failures", "received_first", "early_end"]
register(
    "s7_behaviour_signals",
    lambda t: _behaviour(t).select("session_id", *_FLAGS),
    sql(f"SELECT session_id, {', '.join(_FLAGS)} FROM behaviour", "behaviour"),
)
register(
    "s8_label_hdfs",
    lambda t: ops.with_label(_behaviour(t)).select("session_id", "label"),
    sql("SELECT session_id, label FROM labelled", "labelled"),
)
_GENERIC = "CASE WHEN failures > 0 OR unfinished THEN 1 ELSE 0 END"
register(
    "s9_label_generic",
    lambda t: ops.with_label(_behaviour(t), "generic").select("session_id", "label"),
    sql(f"SELECT session_id, {_GENERIC} AS label FROM behaviour", "behaviour"),
)
_SIGNALS = """array_to_string(list_filter(CASE WHEN label = 1 THEN [
    CASE WHEN failures > 0 THEN 'a failure is named' END,
    CASE WHEN repeated_failures THEN 'failures repeat' END,
    CASE WHEN early_end THEN 'the operation stops early' END,
    CASE WHEN stored = 0 THEN 'no node stored the block' END,
    CASE WHEN early_end THEN 'life cycle cut short' END,
    CASE WHEN unfinished THEN 'reception has no end' END,
    CASE WHEN received_first THEN 'received before it was allocated' END]
  ELSE [
    CASE WHEN received > 0 THEN 'the block was received' END,
    CASE WHEN storing_nodes > 0 THEN concat('stored by ', CAST(storing_nodes AS varchar), ' nodes') END,
    CASE WHEN terminating > 0 THEN 'the responder ended' END,
    CASE WHEN deleted > 0 AND stored > 0 THEN 'deleted after it was stored' END,
    CASE WHEN failures = 0 THEN 'no failure is named' END] END,
  lambda x: x IS NOT NULL)[1:3], '; ')"""
register(
    "s10_signals",
    lambda t: ops.with_signals(ops.with_label(_behaviour(t))).select(
        "session_id", "label", F.array_join("signals", "; ").alias("signals")
    ),
    sql(f"SELECT session_id, label, {_SIGNALS} AS signals FROM labelled", "labelled"),
)
_EVENTS = ("allocated", "receiving", "received", "stored", "terminating", "deleted", "failures")
register(
    "s11_critique_labels",
    lambda t: ops.critique_labels(
        _behaviour(t).withColumn("proposed_label", (F.col("events") % 2).cast("int"))
    ).select("session_id", "proposed_label", "final_label", "changed"),
    sql(
        f"""SELECT session_id, proposed_label, final_label, final_label <> proposed_label AS changed
        FROM (SELECT session_id, CAST(events % 2 AS INTEGER) AS proposed_label,
          CASE WHEN {' + '.join(_EVENTS)} > 0 THEN label ELSE CAST(events % 2 AS INTEGER) END AS final_label
          FROM labelled)""",
        "labelled",
    ),
)
_SUMMARY = """CASE WHEN label = 1 AND failures > 0 THEN concat('The block operation failed: ', CAST(failures AS varchar), ' log events name a failure.')
  WHEN label = 1 THEN 'The block operation started but did not complete, so its execution is incomplete.'
  WHEN stored > 0 THEN concat('The block was received and stored on ', CAST(storing_nodes AS varchar), ' nodes without errors.')
  ELSE 'The block operation ran without errors.' END"""
_EVIDENCE = """array_to_string(list_filter([
    CASE WHEN failures > 0 THEN concat(CAST(failures AS varchar), ' events with a failure word') END,
    CASE WHEN allocated > 0 THEN concat(CAST(allocated AS varchar), ' block allocations') END,
    CASE WHEN receiving > 0 THEN concat(CAST(receiving AS varchar), ' block reception starts') END,
    CASE WHEN received > 0 THEN concat(CAST(received AS varchar), ' completed receptions') END,
    CASE WHEN stored > 0 THEN concat(CAST(stored AS varchar), ' storage confirmations') END,
    CASE WHEN stored = 0 THEN 'No block storage confirmation' END,
    CASE WHEN terminating > 0 THEN concat(CAST(terminating AS varchar), ' packet responder terminations') END,
    CASE WHEN deleted > 0 THEN concat(CAST(deleted AS varchar), ' deletion events') END],
  lambda x: x IS NOT NULL), '; ')"""
_CLASS = "CASE WHEN label = 1 THEN 'ANOMALOUS' ELSE 'NORMAL' END"


def _explained(frame: DataFrame) -> DataFrame:
    return frame.select(
        "session_id",
        "explanation.classification",
        "explanation.summary",
        F.array_join("explanation.key_evidence", "; ").alias("evidence"),
    )


register(
    "s12_explain_sessions",
    lambda t: _explained(ops.explain_sessions(ops.with_label(_behaviour(t)))),
    sql(
        f"SELECT session_id, {_CLASS} AS classification, {_SUMMARY} AS summary, {_EVIDENCE} AS evidence FROM labelled",
        "labelled",
    ),
)
register(
    "s13_detect_and_explain",
    lambda t: ops.detect_and_explain(_hdfs(t)).select(
        "session_id",
        "label",
        F.array_join("signals", "; ").alias("signals"),
        "explanation.summary",
    ),
    sql(
        f"SELECT session_id, label, {_SIGNALS} AS signals, {_SUMMARY} AS summary FROM labelled",
        "labelled",
    ),
)


def _blocks(t: Tables) -> DataFrame:
    return (
        _hdfs(t)
        .select(block_id(_raw()).alias("block_id"))
        .groupBy("block_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


def _ids(t: Tables) -> DataFrame:
    """Block ids with labels: one per labelled document, some without a session."""
    return t.table("labels").select(
        F.concat(F.lit("blk_"), (F.col("doc_id") % 120).cast("string"), F.lit("0"),
                 (F.col("doc_id") % 45).cast("string")).alias("block_id"),
        F.col("toxic").alias("expected_label"),
    )


_IDS = """ids AS (SELECT concat('blk_', CAST(doc_id % 120 AS varchar), '0', CAST(doc_id % 45 AS varchar)) AS block_id,
    toxic AS expected_label FROM labels),
  sess AS (SELECT session_id AS block_id, count(*) AS n_events FROM blocks GROUP BY 1)"""


def _with_ids(body: str) -> str:
    return sql("SELECT 1", "blocks").replace("\nSELECT 1", ",\n" + _IDS + "\n" + body)


register(
    "d1_sessions_with_labels",
    lambda t: ops.sessions_with_labels(_blocks(t), _ids(t)),
    _with_ids("SELECT block_id, n_events, expected_label FROM sess JOIN ids USING (block_id)"),
)
register(
    "d2_selected_sessions",
    lambda t: ops.selected_sessions(_ids(t), _blocks(t)),
    _with_ids("SELECT * FROM ids WHERE block_id IN (SELECT block_id FROM sess)"),
)
register(
    "d3_missing_sessions",
    lambda t: ops.missing_sessions(_ids(t), _blocks(t)),
    _with_ids("SELECT * FROM ids WHERE block_id NOT IN (SELECT block_id FROM sess)"),
)
