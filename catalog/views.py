"""Log-shaped views derived from the given tables, once for Spark and once for DuckDB.

A view is a list of named expressions in the SQL both engines share. ``$S`` is the text
type, ``$DAY`` and ``$TIME`` the two date formats of a log line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {
    "$S": "string",
    "$DAY": "date_format(ts, 'yyyy.MM.dd')",
    "$TIME": "date_format(ts, 'yyyy-MM-dd-HH.mm.ss.SSSSSS')",
}
DUCKDB = {
    "$S": "varchar",
    "$DAY": "strftime(ts, '%Y.%m.%d')",
    "$TIME": "strftime(ts, '%Y-%m-%d-%H.%M.%S.%f')",
}

_NODE = "concat('R', lpad(cast(user_id % 64 as $S), 2, '0'), '-M', cast(user_id % 2 as $S))"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # Lines of ten and more fields, in file order.
    "v_logs": (
        "events",
        {
            "line_no": "event_id + 1",
            "raw_line": f"""concat('- ', cast(event_id as $S), ' ', $DAY, ' ', {_NODE}, ' ', $TIME,
                ' ', {_NODE}, ' RAS ',
                case event_id % 5 when 0 then 'KERNEL' when 1 then 'APP' when 2 then 'KERNEL'
                  when 3 then 'DISCOVERY' else 'MMCS' end, ' ',
                case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING'
                  when 'purchase' then 'FATAL' else 'INFO' end, ' ',
                event_type, ' event on block blk_', cast(user_id as $S),
                ' size ', cast(cast(value as decimal(12,2)) as $S), ' props ', props)""",
        },
    ),
    # Block life-cycle lines with a header.
    "v_hdfs": (
        "events",
        {
            "line_no": "event_id + 1",
            "raw_line": """concat('081109 204005 ', cast(event_id % 97 as $S),
                case event_type
                  when 'signup' then concat(' INFO dfs.FSNamesystem: BLOCK* NameSystem.allocateBlock: /user/root/part-', cast(event_id % 1000 as $S), ' ')
                  when 'view' then ' INFO dfs.DataNode$DataXceiver: Receiving block '
                  when 'click' then ' INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block '
                  when 'purchase' then concat(' INFO dfs.FSNamesystem: BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.251.73.', cast(user_id % 250 as $S), ':50010 is added to ')
                  else ' WARN dfs.DataNode: writeBlock received exception for ' end,
                'blk_', cast(user_id as $S), '0', cast(event_id % 40 as $S),
                case event_type when 'click' then ' terminating'
                  when 'purchase' then ' size 67108864'
                  when 'view' then concat(' src: /10.251.111.', cast(user_id % 250 as $S), ':49851 dest: /10.251.111.130:50010')
                  else '' end)""",
        },
    ),
    # Lines of three kinds in one table: ten fields, two or three fields, one field.
    "v_mixed": (
        "events",
        {
            "file": "concat('f', cast(user_id % 7 as $S), '.log')",
            "line_no": "event_id + 1",
            "value": f"""case event_id % 4
                when 0 then concat('- 1 ', $DAY, ' ', {_NODE}, ' ', $TIME, ' ', {_NODE}, ' RAS APP INFO ', event_type, ' done')
                when 1 then concat($TIME, ' INFO ', event_type, ' seen')
                when 2 then concat($TIME, ' ERROR')
                else event_type end""",
        },
    ),
    "v_results": (
        "events",
        {
            "event_id": "event_id",
            "config_name": """concat(case when event_id % 2 = 0 then 'baseline_' else 'evaluator_' end,
                'm', cast(event_id % 3 as $S),
                case when event_id % 5 < 3 then '_with_preprocessing' else '_no_preprocessing' end)""",
            "model": "concat('m', cast(event_id % 3 as $S))",
            "workflow": "case when event_id % 2 = 0 then 'simple' else 'evaluator' end",
            "preprocessing": "event_id % 5 < 3",
            "question_id": "concat('q', cast(event_id % 18 + 1 as $S))",
            "correct": "(user_id + event_id) % 4 <> 0",
            "time_seconds": "value",
            "tokens_input": "user_id * 10",
            "tokens_output": "user_id",
            "tokens_total": "user_id * 11",
        },
    ),
    "v_responses": (
        "events",
        {
            "event_id": "event_id",
            "question_id": "concat('q', cast(event_id % 18 + 1 as $S))",
            "response": """case event_id % 7
                when 0 then concat('{"answer": ', cast(user_id as $S), '}')
                when 1 then concat('I counted ', cast(user_id as $S), ' such lines')
                when 2 then concat('```json', chr(10), '{"answer": "', event_type, '"}', chr(10), '```')
                when 3 then concat('It must be "', event_type, '", I think.')
                when 4 then '["error", "view", "click"]'
                when 5 then concat('{"label": ', cast(event_id % 2 as $S), ', "signals": ["x"]}')
                else 'no idea' end""",
            "tolerance": "cast(event_id % 3 as int)",
            "expected_int": "user_id + event_id % 2",
            "expected_text": "event_type",
            "verdict_text": """case event_id % 5
                when 0 then '{"acceptable": true, "reasoning": "fine"}'
                when 1 then concat('```json', chr(10), '{"acceptable": false, "reasoning": "short", "suggestions": "more"}', chr(10), '```')
                when 2 then 'This is GOOD work'
                when 3 then concat('```', chr(10), '{"acceptable": 0}', chr(10), '```')
                else concat('nothing in ', event_type) end""",
        },
    ),
    "v_predictions": (
        "events",
        {
            "event_id": "event_id",
            "run": "concat('run', cast(event_id % 5 as $S))",
            "expected": "cast(user_id % 2 as int)",
            "predicted": "case when event_id % 11 = 0 then null else cast((user_id + event_id % 3) % 2 as int) end",
        },
    ),
    "v_sessions": (
        "conversations",
        {
            "session_id": "concat('run_', lpad(cast(conv_id as $S), 8, '0'))",
            "interaction_no": "turn",
            "agent": "role",
            "parent": "case when turn = 0 then null else 'user' end",
            "message": "text",
            "start_time": "cast(turn as double)",
            "duration": "cast(length(text) as double) / 100",
        },
    ),
    "v_vectors": (
        "embeddings",
        {"chunk_index": "vec_id", "vec": "embedding", "file": "concat('label', cast(label as $S))"},
    ),
}


def _translate(text: str, dialect: dict[str, str]) -> str:
    for token in ("$DAY", "$TIME"):
        text = text.replace(token, dialect[token])
    # "$S" would also match inside "$DataXceiver" only if it began with S; it does not.
    return text.replace("$S", dialect["$S"])


def duckdb_view(name: str) -> str:
    """SELECT text of a view."""
    table, columns = VIEWS[name]
    fields = ", ".join(f'{_translate(e, DUCKDB)} AS "{n}"' for n, e in columns.items())
    return f"SELECT {fields} FROM {table}"


# Further relations for the SQL side, in order of dependency.
RELATIONS: dict[str, str] = {
    "p": r"""SELECT line_no, parts[5] AS "timestamp", parts[6] AS node_id, parts[9] AS level,
          parts[8] AS component,
          regexp_extract(raw_line, '^(?:\S+\s+){9}(.*)$', 1) AS message, raw_line
        FROM (SELECT *, string_split_regex(raw_line, '\s+') AS parts FROM v_logs)
        WHERE len(parts) >= 10""",
    "ph": r"""SELECT *, CASE WHEN len(string_split("timestamp", '-')) >= 4
          THEN string_split(string_split("timestamp", '-')[4], '.')[1] END AS hour FROM p""",
    "logs": """SELECT CAST(line_no AS BIGINT) AS id, "timestamp", level, component, message, raw_line,
          'events.log' AS file_source FROM p""",
    "blocks": r"""SELECT line_no, raw_line, regexp_extract(raw_line, 'blk_-?\d+') AS session_id,
          regexp_replace(raw_line, '^\d{6}\s+\d{6}(\s+\d+)?\s+[A-Z]+\s+\S+:\s+', '') AS body
        FROM v_hdfs WHERE regexp_matches(raw_line, 'blk_-?\d+')""",
    "doc_lines": """SELECT concat(source, '/', CAST(doc_id AS varchar)) AS file,
          unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no,
          unnest(string_split(text, chr(10))) AS value FROM documents""",
    "iter_lines": """SELECT session_id, interaction_no, start_time,
          len(string_split(message, chr(10))) AS n_iterations,
          unnest(generate_series(1, len(string_split(message, chr(10))))) - 1 AS iteration_no,
          unnest(string_split(message, chr(10))) AS line FROM v_sessions""",
    "features": r"""SELECT session_id, count(*) AS events,
          count(*) FILTER (contains(body, 'allocateBlock')) AS allocated,
          count(*) FILTER (contains(body, 'Receiving block')) AS receiving,
          count(*) FILTER (contains(body, 'Received block')) AS received,
          count(*) FILTER (contains(body, 'addStoredBlock')) AS stored,
          count(*) FILTER (contains(body, 'terminating')) AS terminating,
          count(*) FILTER (contains(body, 'NameSystem.delete') OR contains(body, 'Deleting block')) AS deleted,
          count(*) FILTER (regexp_matches(body, '(?i)error|fail|exception|crash|interrupt|fatal')) AS failures,
          count(DISTINCT nullif(regexp_extract(body, 'blockMap updated: (\S+) is added to', 1), '')) AS storing_nodes,
          min(line_no) FILTER (contains(body, 'allocateBlock')) AS first_allocated,
          min(line_no) FILTER (contains(body, 'Received block')) AS first_received
        FROM blocks GROUP BY session_id""",
    "behaviour": """SELECT *, allocated > 0 AND stored = 0 AS missing_storage,
          receiving > 0 AND received = 0 AND terminating = 0 AS unfinished,
          failures >= 2 AS repeated_failures,
          coalesce(first_received < first_allocated, false) AS received_first,
          (allocated > 0 OR receiving > 0) AND stored = 0 AND received = 0 AND terminating = 0 AS early_end
        FROM features""",
    "labelled": """SELECT *, CASE WHEN failures > 0 OR stored = 0 THEN 1 ELSE 0 END AS label FROM behaviour""",
}

NEEDS = {
    "p": ["v_logs"],
    "ph": ["p"],
    "logs": ["p"],
    "blocks": ["v_hdfs"],
    "features": ["blocks"],
    "behaviour": ["features"],
    "labelled": ["behaviour"],
    "doc_lines": [],
    "iter_lines": ["v_sessions"],
}


def sql(body: str, *relations: str) -> str:
    """``body`` with the relations it names, and what those need, as WITH clauses."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in relations:
        add(name)
    parts = [f"{n} AS ({RELATIONS[n] if n in RELATIONS else duckdb_view(n)})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


class Tables:
    """The given tables of one scale factor, and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table, columns = VIEWS[name]
        return self.table(table).select(
            *(F.expr(_translate(e, SPARK)).alias(n) for n, e in columns.items())
        )

    def parsed(self) -> DataFrame:
        from cairnlog.operators.stats import parse_lines

        return parse_lines(self.view("v_logs"))

    def logs(self) -> DataFrame:
        from cairnlog.functions.parsing import parse_bgl
        from cairnlog.sources.logs import logs_rows, with_record

        lines = with_record(self.view("v_logs"), parse_bgl(F.col("raw_line")))
        return logs_rows(lines, F.col("line_no"), F.col("raw_line"), F.lit("events.log"))

    def doc_lines(self) -> DataFrame:
        """Each document as a file of lines."""
        return self.table("documents").select(
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"),
            F.posexplode(F.split("text", "\n")).alias("_place", "value"),
        ).select("file", (F.col("_place") + 1).cast("long").alias("line_no"), "value")

    def interactions(self) -> DataFrame:
        """One interaction per turn; each of its lines is an iteration."""
        turns = self.view("v_sessions")
        lines = F.split("message", "\n")
        calls = F.size(F.filter(lines, lambda x: F.length(x) > 20)).cast("long")
        whole = self.sessions()
        return (
            turns.join(whole.withColumnRenamed("duration", "run_duration"), "session_id")
            .withColumn("n_iterations", F.size(lines).cast("long"))
            .withColumn("total_tool_calls", calls)
        )

    def sessions(self) -> DataFrame:
        return self.view("v_sessions").groupBy("session_id").agg(
            (F.sum(F.length("message")).cast("double") / 100).alias("duration")
        )

    def iterations(self) -> DataFrame:
        lines = F.split("message", "\n")
        size = F.length("line").cast("long")
        call = F.struct(
            F.concat(F.lit("tool"), (size % 4).cast("string")).alias("name"),
            F.lit("{}").alias("arguments"),
            F.concat_ws("-", "session_id", "interaction_no", "iteration_no").alias("id"),
        )
        return (
            self.view("v_sessions")
            .select(
                "session_id",
                "interaction_no",
                "start_time",
                F.size(lines).cast("long").alias("n_iterations"),
                F.posexplode(lines).alias("iteration_no", "line"),
            )
            .withColumn("iteration_no", F.col("iteration_no").cast("long"))
            .select(
                "session_id",
                "interaction_no",
                "iteration_no",
                "n_iterations",
                (F.col("iteration_no") + 1).alias("iteration"),
                (F.col("start_time") + F.col("iteration_no")).alias("timestamp"),
                F.when(size > 20, F.array(call)).alias("tool_calls"),
                F.when(
                    (size > 20) & (size % 3 != 0),
                    F.array(
                        F.struct(
                            call["name"].alias("name"), call["id"].alias("id"),
                            F.substring("line", 1, 5).alias("result"),
                        )
                    ),
                ).alias("tool_call_results"),
                size.alias("input_tokens"),
                (size % 7).alias("output_tokens"),
                (size + size % 7).alias("total_tokens"),
            )
        )
