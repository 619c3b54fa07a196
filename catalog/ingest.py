"""Ingestion, parsers and queries over ``logs``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.functions import parsing, text
from cairnlog.operators import logs as ops
from cairnlog.plans.files import new_folder
from cairnlog.sources.evaluations import filter_configs, last_labels
from cairnlog.sources.logs import detect_formats, ingest_logs, ingest_stats, parse_detected, table_stats

from . import register
from .views import Tables, sql

FIELDS = ("timestamp", "level", "component", "message")


def _records(frame, *keys):
    return frame.select(*keys, *(F.col(f"record.{name}").alias(name) for name in FIELDS))


def _mixed_sql(columns: str, where: str = "") -> str:
    body = rf"""SELECT {columns} FROM (SELECT *, string_split_regex(value, '\s+') AS parts,
        regexp_extract(value, '^(?:\S+\s+){{9}}(.*)$', 1) AS rest9,
        regexp_extract(value, '^(?:\S+\s+){{2}}(.*)$', 1) AS rest2 FROM v_mixed) {where}"""
    return body


_BGL = {"timestamp": "parts[5]", "level": "parts[9]", "component": "parts[8]", "message": "rest9"}
_GENERIC = {"timestamp": "parts[1]", "level": "parts[2]", "component": "''", "message": "rest2"}


def _columns(bgl: bool, generic: bool) -> str:
    fields = []
    for name in FIELDS:
        cases = "CASE"
        if bgl:
            cases += f" WHEN len(parts) >= 10 THEN {_BGL[name]}"
        if generic:
            cases += f" WHEN len(parts) >= 2 THEN {_GENERIC[name]}"
        fields.append(f'{cases} END AS "{name}"')
    return "line_no, " + ", ".join(fields)


register("a3_logs_table", Tables.logs, sql("SELECT * FROM logs", "logs"))


def _ingested(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The lines of all documents, written as files in their order and ingested."""
    spark, folder = t.spark, new_folder(t.spark, "document-lines")
    # Readers of text end a line at a carriage return, too.
    lines = F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("place", "value")
    placed = t.table("documents").select("doc_id", lines)
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.select("value").write.text(f"{folder}/lines")
    stats = ingest_logs(spark, f"{folder}/lines", f"{folder}/logs", "per_line", pattern="part-*")
    return spark.read.parquet(f"{folder}/logs"), stats


# The characters that count as white space, for patterns and for trimming.
_BLANK = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DOCUMENT_LINES = rf"""document_lines AS (
    SELECT doc_id, place, value, string_split_regex(value, '[{_BLANK}]+') AS parts FROM (
      SELECT doc_id, place, regexp_replace(regexp_replace(line, '^[{_BLANK}]+', ''), '[{_BLANK}]+$', '') AS value
      FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (
        SELECT doc_id, string_split(replace(text, chr(13), ' '), chr(10)) AS lines FROM documents)))
    WHERE value <> ''),
  parsed_lines AS (SELECT *, len(parts) >= 10 AS long,
    regexp_extract(value, '(?s)^(?:[^{_BLANK}]+[{_BLANK}]+){{9}}(.*)$', 1) AS rest9,
    regexp_extract(value, '(?s)^(?:[^{_BLANK}]+[{_BLANK}]+){{2}}(.*)$', 1) AS rest2 FROM document_lines)"""

register(
    "a3_ingest_logs",
    lambda t: _ingested(t)[0].drop("file_source"),
    f"""WITH {_DOCUMENT_LINES}
    SELECT row_number() OVER (ORDER BY doc_id, place) AS id,
      CASE WHEN long THEN parts[5] ELSE parts[1] END AS "timestamp",
      CASE WHEN long THEN parts[9] ELSE parts[2] END AS level,
      CASE WHEN long THEN parts[8] ELSE '' END AS component,
      CASE WHEN long THEN rest9 ELSE rest2 END AS message, value AS raw_line
    FROM parsed_lines WHERE len(parts) >= 2""",
)
register(
    "a3_ingest_logs_stats",
    lambda t: _ingested(t)[1].select("total_lines", "error_count"),
    f"""WITH {_DOCUMENT_LINES}
    SELECT count(*) AS total_lines,
      count(*) FILTER (CASE WHEN long THEN parts[9] WHEN len(parts) >= 2 THEN parts[2] END = 'ERROR') AS error_count
    FROM parsed_lines""",
)


def _mixed_parsed(t: Tables):
    return t.view("v_mixed").withColumn("record", parsing.parse_auto(F.col("value")))


register(
    "a4_ingest_stats",
    lambda t: ingest_stats(_mixed_parsed(t)),
    sql(
        _mixed_sql(
            """count(*) AS total_lines, count(DISTINCT file) AS files_processed,
            count(*) FILTER (CASE WHEN len(parts) >= 10 THEN parts[9] WHEN len(parts) >= 2 THEN parts[2] END = 'ERROR') AS error_count"""
        ),
        "v_mixed",
    ),
)
register(
    "a5_table_stats",
    lambda t: table_stats(t.logs()),
    sql(
        """SELECT count(*) AS total_lines, count(*) FILTER (level = 'ERROR') AS error_count,
        CAST(0 AS BIGINT) AS files_processed FROM logs""",
        "logs",
    ),
)
register(
    "a7_labels",
    lambda t: last_labels(
        t.table("labels").select(
            F.concat(F.lit("blk_"), (F.col("doc_id") % 100).cast("string")).alias("BlockId"),
            F.when(F.col("toxic") == 1, " ANOMALY").otherwise("Normal").alias("Label"),
            "doc_id",
        ),
        "doc_id",
    ),
    """SELECT concat('blk_', CAST(doc_id % 100 AS varchar)) AS block_id,
      CAST(arg_max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END, doc_id) AS INTEGER) AS expected_label
    FROM labels GROUP BY 1""",
)

register(
    "b1_parse_openstack",
    lambda t: _records(
        t.view("v_logs").withColumn(
            "record",
            parsing.parse_openstack(
                F.regexp_replace(
                    "raw_line",
                    r"^.* (\d{4}-\d\d-\d\d)-(\d\d)\.(\d\d)\.(\d\d)\.(\d+) \S+ \S+ (\S+) (\S+) (.*)$",
                    "$1 $2:$3:$4.$5 $7 nova.$6 [req-1 - -] $8",
                )
            ),
        ),
        "line_no",
    ),
    sql(
        """SELECT line_no, concat("timestamp"[1:10], ' ', replace("timestamp"[12:19], '.', ':'), "timestamp"[20:]) AS "timestamp",
        level, concat('nova.', component) AS component, message FROM p""",
        "p",
    ),
)
register(
    "b2_parse_bgl",
    lambda t: _records(
        t.view("v_mixed").withColumn("record", parsing.parse_bgl(F.col("value"))), "line_no"
    ),
    sql(_mixed_sql(_columns(True, False)), "v_mixed"),
)
register(
    "b3_parse_generic",
    lambda t: _records(
        t.view("v_mixed").withColumn("record", parsing.parse_generic(F.col("value"))), "line_no"
    ),
    sql(_mixed_sql(_columns(False, True)), "v_mixed"),
)
register(
    "b4_parse_auto",
    lambda t: _records(_mixed_parsed(t), "line_no"),
    sql(_mixed_sql(_columns(True, True)), "v_mixed"),
)
_FORMATS = r"""formats AS (SELECT file, CASE WHEN len(string_split_regex(arg_min(value, line_no), '\s+')) >= 10
      THEN 'bgl' ELSE 'generic' END AS format FROM v_mixed GROUP BY file)"""
register(
    "b5_detect_formats",
    lambda t: detect_formats(t.view("v_mixed")),
    sql("SELECT file, format FROM formats", "v_mixed").replace(
        "\nSELECT file", ",\n" + _FORMATS + "\nSELECT file"
    ),
)
_DETECTED = "line_no, " + ", ".join(
    f"""CASE WHEN format = 'bgl' THEN CASE WHEN len(parts) >= 10 THEN {_BGL[n]} END
      WHEN len(parts) >= 2 THEN {_GENERIC[n]} END AS "{n}\""""
    for n in FIELDS
)
register(
    "b5_parse_detected",
    lambda t: _records(parse_detected(t.view("v_mixed")), "line_no"),
    sql("SELECT 1", "v_mixed").replace(
        "\nSELECT 1",
        ",\n" + _FORMATS + "\n" + _mixed_sql(_DETECTED, "JOIN formats USING (file)"),
    ),
)


def _two_fields(line: str) -> dict | None:
    part = line.split(maxsplit=2)
    if len(part) < 2:
        return None
    return {"timestamp": part[0], "level": part[1], "message": part[2] if len(part) > 2 else ""}


register(
    "b6_parse_with_user_parser",
    lambda t: _records(
        t.view("v_mixed").withColumn("record", parsing.parse_with(_two_fields)(F.col("value"))),
        "line_no",
    ),
    sql(_mixed_sql(_columns(False, True)), "v_mixed"),
)
register(
    "b7_parse_bgl_node",
    Tables.parsed,
    sql('SELECT line_no, "timestamp", node_id, level, component, message FROM p', "p"),
)

register(
    "c1_query_logs",
    lambda t: ops.query_logs(
        t.logs(),
        "SELECT component, level, count(*) AS n FROM logs WHERE level <> ? AND id > ? "
        "GROUP BY component, level",
        ["INFO", 10],
    ),
    sql(
        """SELECT component, level, count(*) AS n FROM logs WHERE level <> 'INFO' AND id > 10
        GROUP BY component, level""",
        "logs",
    ),
)
register(
    "c2_error_logs",
    lambda t: ops.error_logs(t.logs(), 100),
    sql("""SELECT * FROM logs WHERE level = 'ERROR' ORDER BY "timestamp" DESC, id LIMIT 100""", "logs"),
)
register(
    "c3_search_logs",
    lambda t: ops.search_logs(t.logs(), "PURCH%block blk_1", 100),
    sql("SELECT * FROM logs WHERE message ILIKE '%PURCH%block blk_1%' ORDER BY id LIMIT 100", "logs"),
)
register(
    "c4_by_component",
    lambda t: ops.by_component(t.logs(), "DISCOVERY"),
    sql("SELECT * FROM logs WHERE component = 'DISCOVERY'", "logs"),
)
register(
    "c4_by_level",
    lambda t: ops.by_level(t.logs(), "FATAL"),
    sql("SELECT * FROM logs WHERE level = 'FATAL'", "logs"),
)
register(
    "c5_filter_configs",
    lambda t: filter_configs(
        t.view("v_results").select("event_id", F.col("config_name").alias("name")), "m1_with"
    ),
    sql(
        "SELECT event_id, config_name AS name FROM v_results WHERE contains(config_name, 'm1_with')",
        "v_results",
    ),
)


def _redacted(t: Tables):
    config = F.create_map(
        F.lit("model"), F.col("event_type"), F.lit("OPENAI_API_KEY"), F.col("props")
    )
    redacted = text.redact_config(config)
    return t.table("events").select(
        "event_id",
        redacted["model"].alias("model"),
        redacted["OPENAI_API_KEY"].alias("key"),
    )


register(
    "c6_redact_config",
    _redacted,
    "SELECT event_id, event_type AS model, '[REDACTED]' AS key FROM events",
)
register(
    "c7_preview",
    lambda t: t.table("documents").select(
        "doc_id",
        text.preview(F.col("text")).alias("preview"),
        text.line_span(F.col("doc_id"), F.col("n_chars")).alias("lines"),
    ),
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(text[1:500], '...') ELSE text END AS preview,
      concat(CAST(doc_id AS varchar), '-', CAST(n_chars AS varchar)) AS lines FROM documents""",
)
register(
    "c8_truncate_notice",
    lambda t: t.table("documents").select(
        "doc_id", text.truncate_notice(F.col("text"), 200).alias("shown")
    ),
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(text[1:200],
      '...[truncated]. This content was truncated at 200 characters. Full output length: ',
      CAST(length(text) AS varchar), ' characters.') ELSE text END AS shown FROM documents""",
)
register(
    "c9_display_name",
    lambda t: t.view("v_results").select(
        "event_id", text.display_name(F.col("config_name")).alias("shown")
    ),
    sql(
        """SELECT event_id, replace(replace(replace(replace(config_name, 'baseline_', ''),
        'evaluator_', 'eval_'), '_with_preprocessing', '+prep'), '_no_preprocessing', '') AS shown
        FROM v_results""",
        "v_results",
    ),
)

register("e1_total_logs", lambda t: ops.total_logs(t.logs()), sql("SELECT count(*) AS total_logs FROM logs", "logs"))
register(
    "e2_logs_by_level",
    lambda t: ops.logs_by_level(t.logs()),
    sql("SELECT level, count(*) AS count FROM logs GROUP BY level", "logs"),
)
register(
    "e3_top_components",
    lambda t: ops.top_components(t.logs()),
    sql(
        "SELECT component, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "logs",
    ),
)
register(
    "e1_e3_log_stats",
    lambda t: ops.log_stats(t.logs()),
    sql(
        """SELECT 'total_logs' AS metric, CAST(NULL AS varchar) AS key, count(*) AS value FROM logs
        UNION ALL SELECT 'by_level', level, count(*) FROM logs GROUP BY level
        UNION ALL SELECT * FROM (SELECT 'top_components', component, count(*) AS n FROM logs
          GROUP BY component ORDER BY n DESC, component LIMIT 10)""",
        "logs",
    ),
)
