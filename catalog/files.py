"""Readers and writers of files, over files that Spark makes from the given tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.files import new_folder, write_bytes
from cairnlog.plans.shipping import ship_code
from cairnlog.sources import evaluations as ev
from cairnlog.sources.chunks import read_chunks, write_chunks
from cairnlog.sources.logs import read_log_lines, with_line_numbers
from cairnlog.steps import ChunkVectors, LogTable, StepRunner

from . import CATALOG, register
from .ingest import _columns, _mixed_sql
from .vectors import OVERLAP, SIZE, _chunks
from .views import Tables, sql

#: Lines of one log file, and rows of one result file.
LINES = 400
RESULT_ROWS = 50_000
#: Folders over which the files of sessions are dealt.
SESSION_FOLDERS = 256


def _written(files: DataFrame, label: str) -> str:
    """The folder of files with the given ``name`` and ``content``, written by tasks."""
    spark = files.sparkSession
    ship_code(spark)
    folder = new_folder(spark, label)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                write_bytes(f"{folder}/{name}", content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def _joined(lines: DataFrame, name, label: str) -> str:
    """Lines gathered to files of bounded size, in the order of ``line_no``."""
    gathered = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    text = F.array_join(F.transform(gathered, lambda x: x["value"]), "\n")
    return _written(lines.groupBy(name.alias("name")).agg(text.alias("content")), label)


def _mixed_files(t: Tables) -> str:
    number = F.floor((F.col("line_no") - 1) / LINES).cast("string")
    return _joined(t.view("v_mixed"), F.concat(F.lit("part"), F.lpad(number, 6, "0"), F.lit(".log")), "mixed-files")


_FILE = f"concat('part', lpad(CAST((line_no - 1) // {LINES} AS varchar), 6, '0'), '.log')"
register(
    "a1_read_log_lines",
    lambda t: read_log_lines(t.spark, _mixed_files(t)).select("file", "value"),
    sql(f"SELECT {_FILE} AS file, value FROM v_mixed", "v_mixed"),
)
register(
    "a2_with_line_numbers",
    lambda t: with_line_numbers(read_log_lines(t.spark, _mixed_files(t))).select("file", "line_no", "value"),
    sql(f"SELECT {_FILE} AS file, (line_no - 1) % {LINES} + 1 AS line_no, value FROM v_mixed", "v_mixed"),
)


def _stored(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "all-chunks")
    write_chunks(_chunks(t), folder, chunk_size=SIZE, overlap=OVERLAP, model_name="none", per_part=1_000)
    chunks, config = read_chunks(t.spark, folder)
    return chunks.withColumns({name: config.select(name).scalar() for name in config.columns})


register(
    "a6_write_chunks",
    _stored,
    CATALOG["v1_chunk_lines"].sql.replace(
        "SELECT * FROM chunks", f"SELECT *, {SIZE} AS chunk_size, {OVERLAP} AS overlap, 'none' AS model_name FROM chunks"
    ),
)


def _session_files(t: Tables) -> str:
    """A pattern of folders: no folder has all files."""
    keyed = t.view("v_hdfs").select(
        "line_no", F.col("raw_line").alias("value"), F.regexp_extract("raw_line", r"blk_-?\d+", 0).alias("id")
    )
    folder = F.pmod(F.xxhash64("id"), F.lit(SESSION_FOLDERS)).cast("string")
    # Lines without an id go to a file that is no session's.
    name = F.coalesce(F.concat("id", F.lit(".log")), F.lit("None"))
    return _joined(keyed, F.concat(folder, F.lit("/"), name), "session-files") + "/*"


_BLOCKS = r"SELECT *, regexp_extract(raw_line, 'blk_-?\d+') AS block_id FROM v_hdfs"
register(
    "a8_read_session_files",
    lambda t: ev.read_session_files(t.spark, _session_files(t)),
    sql(
        f"""SELECT block_id, string_agg(raw_line, chr(10) ORDER BY line_no) AS logs FROM ({_BLOCKS}) GROUP BY block_id""",
        "v_hdfs",
    ),
)
register(
    "a8_read_session_lines",
    lambda t: ev.read_session_lines(t.spark, _session_files(t)),
    sql(
        f"""SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY line_no) AS line_no, raw_line AS value
        FROM ({_BLOCKS})""",
        "v_hdfs",
    ),
)

# Expressions of a result row that both engines read; some cells are hard to quote.
_RESULT = {
    "start_time": "concat('t', cast(event_id as $S))", "config_name": "config_name", "provider": "'p, \"q\"'", "model": "model",
    "workflow": "workflow", "preprocessing": "preprocessing", "embeddings": "event_id % 2 = 0", "question_id": "question_id",
    "question": "concat('what, \"', question_id, '\" ', chr(10), 'then?')", "answer_type": "'integer'",
    "expected": "cast(event_id as $S)", "answer": "case when correct then cast(event_id as $S) end", "correct": "correct",
    "reason": "'because'", "time_seconds": "time_seconds", "tokens_input": "tokens_input", "tokens_output": "tokens_output",
    "tokens_total": "tokens_total", "error": "case when not correct then 'wrong' end",
}


def _result_rows(t: Tables) -> DataFrame:
    rows = t.view("v_results")
    return rows.select(*(F.expr(e.replace("$S", "string").replace("chr(10)", "'\\n'")).alias(n) for n, e in _RESULT.items()))


def _result_sql(names) -> str:
    cells = (f'{e.replace("$S", "varchar")} AS "{n}"' for n, e in _RESULT.items() if n in names)
    return f"SELECT {', '.join(cells)} FROM v_results"


def _results_written(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "results")
    ev.write_results(_result_rows(t), folder)
    return ev.read_results(t.spark, [folder, f"{folder}-missing"])


register("a13_write_results", _results_written, sql(_result_sql(_RESULT), "v_results"))


def _results_of_many_files(t: Tables) -> DataFrame:
    """Files with other columns, in other orders; one has a column that no schema knows."""
    folder = new_folder(t.spark, "result-files")
    rows = _result_rows(t)
    halves = (
        rows.where("embeddings").select(*reversed(rows.columns)).withColumn("note", F.lit("n")),
        rows.where("not embeddings").select("question_id", "correct", "config_name", "tokens_total", "time_seconds"),
    )
    # A file whose cells hold line ends is read by one task, so files stay of one size.
    files = max(7, -(-rows.count() // (2 * RESULT_ROWS)))
    for number, half in enumerate(halves):
        half.repartition(files).write.csv(f"{folder}/{number}", header=True, escape='"')
    return ev.read_results(t.spark, [f"{folder}/0", f"{folder}/1"])


_FEW = ("question_id", "correct", "config_name", "tokens_total", "time_seconds")
register(
    "a9_read_results",
    _results_of_many_files,
    sql(
        f"""SELECT *, 'n' AS note FROM ({_result_sql(_RESULT)} WHERE event_id % 2 = 0)
        UNION ALL BY NAME {_result_sql(_FEW)} WHERE event_id % 2 = 1""",
        "v_results",
    ),
)


def _labels_written(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "labels")
    labels = t.table("labels").select(
        F.concat(F.lit("blk_"), F.col("doc_id").cast("string")).alias("BlockId"),
        F.when(F.col("toxic") == 1, "Anomaly").otherwise("Normal").alias("Label"),
    )
    ev.write_labels(labels, folder)
    return ev.read_labels(t.spark, folder)


register(
    "a15_write_labels",
    _labels_written,
    """SELECT concat('blk_', CAST(doc_id AS varchar)) AS block_id,
      CAST(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS INTEGER) AS expected_label FROM labels GROUP BY doc_id""",
)


def _evaluation_files(t: Tables) -> str:
    """One document for every 200 predictions."""
    tests = F.struct(
        F.concat(F.lit("blk_"), F.col("event_id").cast("string")).alias("block_id"),
        F.col("expected").alias("expected_label"),
        F.col("predicted").alias("predicted_label"),
        (F.col("expected") == F.col("predicted")).alias("correct"),
    )
    number = F.floor(F.col("event_id") / 200).cast("string")
    grouped = t.view("v_predictions").groupBy(number.alias("number")).agg(
        F.collect_list(tests).alias("test_results"), F.count(F.lit(1)).alias("total")
    )
    document = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("e"), "number").alias("experiment"), F.lit("m").alias("model")).alias("metadata"),
            F.struct(F.col("total").alias("total")).alias("metrics"),
            "test_results",
        )
    )
    return _written(
        grouped.select(F.concat(F.lit("eval_"), "number", F.lit(".json")).alias("name"), document.alias("content")),
        "evaluations",
    )


register(
    "a10_read_evaluations",
    lambda t: ev.read_evaluations(t.spark, _evaluation_files(t)).select(
        "_filename",
        F.col("metadata.experiment").alias("experiment"),
        F.col("metrics.total").alias("total"),
        F.explode("test_results").alias("test"),
    ).select("_filename", "experiment", "total", "test.block_id", "test.expected_label", "test.predicted_label", "test.correct"),
    sql(
        """SELECT concat('eval_', CAST(event_id // 200 AS varchar), '.json') AS _filename,
          concat('e', CAST(event_id // 200 AS varchar)) AS experiment,
          count(*) OVER (PARTITION BY event_id // 200) AS total, concat('blk_', CAST(event_id AS varchar)) AS block_id,
          expected AS expected_label, predicted AS predicted_label, expected = predicted AS correct FROM v_predictions""",
        "v_predictions",
    ),
)


def _run_files(t: Tables) -> str:
    turn = F.struct(
        F.col("interaction_no").alias("n"),
        F.struct("agent", "parent", "message", F.lit(0.5).alias("duration"), F.lit(1).alias("total_tool_calls")).alias("i"),
    )
    runs = t.view("v_sessions").groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    config = F.create_map(F.lit("model"), F.lit("m"), F.lit("api_key"), F.col("session_id"))
    document = F.to_json(
        F.struct(
            "session_id",
            F.lit(2.5).alias("duration"),
            config.alias("config"),
            F.transform("turns", lambda x: x["i"]).alias("interactions"),
        )
    )
    return _written(
        runs.select(F.concat("session_id", F.lit(".json")).alias("name"), document.alias("content")), "run-logs"
    )


register(
    "a11_read_run_logs",
    lambda t: ev.read_run_logs(t.spark, _run_files(t)).select(
        "_filename",
        "duration",
        F.col("config")["model"].alias("model"),
        F.col("config")["api_key"].alias("api_key"),
        F.posexplode("interactions").alias("place", "i"),
    ).select("_filename", "duration", "model", "api_key", "place", "i.agent", "i.parent", "i.message", "i.total_tool_calls"),
    sql(
        """SELECT concat(session_id, '.json') AS _filename, CAST(2.5 AS double) AS duration, 'm' AS model,
          '[REDACTED]' AS api_key, CAST(row_number() OVER (PARTITION BY session_id ORDER BY interaction_no) - 1 AS INTEGER) AS place,
          agent, parent, message, CAST(1 AS BIGINT) AS total_tool_calls FROM v_sessions""",
        "v_sessions",
    ),
)


def _config_files(t: Tables) -> str:
    """Lists of configurations, one per model, and single ones, with both spellings of switches."""
    rows = t.view("v_results").select("config_name", "model", "workflow", "preprocessing").distinct()
    named = F.struct(
        F.col("config_name").alias("name"), "model", F.when(F.col("workflow") != "simple", F.col("workflow")).alias("workflow"),
        F.when(F.col("preprocessing"), True).alias("preprocessing"),
        F.when(~F.col("preprocessing"), False).alias("use_preprocessing"),
        F.when(F.col("preprocessing"), 3).alias("max_iterations"),
    )
    listed = rows.where("workflow = 'simple'").groupBy("model").agg(F.to_json(F.collect_list(named)).alias("content"))
    single = rows.where("workflow <> 'simple'").select("config_name", F.to_json(named).alias("content"))
    return _written(
        listed.select(F.concat("model", F.lit(".json")).alias("name"), "content").unionByName(
            single.select(F.concat("config_name", F.lit(".json")).alias("name"), "content")
        ),
        "configs",
    )


register(
    "a12_read_experiment_configs",
    lambda t: ev.read_experiment_configs(t.spark, _config_files(t)).select(
        "name", "task", "model", "description", "workflow", "use_preprocessing", "use_embeddings", "max_iterations"
    ),
    sql(
        """SELECT DISTINCT config_name AS name, 'anomaly_detection' AS task, model, '' AS description, workflow,
          preprocessing AS use_preprocessing, false AS use_embeddings,
          CAST(CASE WHEN preprocessing THEN 3 ELSE 10 END AS INTEGER) AS max_iterations FROM v_results""",
        "v_results",
    ),
)


def _prepared(t: Tables) -> DataFrame:
    """Levels by a query on the table one step has made, and what the other step says of its chunks."""
    runner = StepRunner([LogTable("per_line"), ChunkVectors(size=50, overlap=0)])
    meta = runner.run(t.spark, _mixed_files(t), new_folder(t.spark, "steps"))
    levels = runner.tools()["query_logs"]("SELECT level, count(*) AS n FROM logs GROUP BY level")
    return levels.withColumns(
        {
            "total_lines": meta["log_table"].select("total_lines").scalar(),
            "num_chunks": meta["chunk_vectors"].select("num_chunks").scalar(),
        }
    )


register(
    "p1_step_runner",
    _prepared,
    sql(
        f"""SELECT level, count(*) AS n, (SELECT count(*) FROM v_mixed) AS total_lines,
          (SELECT CAST(sum((n + 49) // 50) AS BIGINT) FROM (SELECT count(*) AS n FROM v_mixed GROUP BY (line_no - 1) // {LINES})) AS num_chunks
        FROM ({_mixed_sql(_columns(True, True))}) WHERE level IS NOT NULL GROUP BY level""",
        "v_mixed",
    ),
)
