"""Round trips through files."""

import json

import pytest
from pyspark.sql import functions as F

from cairnlog import schemas
from cairnlog.operators.results import comparison_table
from cairnlog.functions.parsing import parse_with
from cairnlog.operators.logs import error_logs, query_logs, search_logs
from cairnlog.operators.questions import generate_questions
from cairnlog.operators.runs import (
    interactions_table,
    iterations_table,
    last_iteration_tokens,
    run_summary,
    token_usage,
    tool_call_results,
    tool_calls_table,
    tool_results_table,
)
from cairnlog.operators.stats import log_facts, parse_lines, statistics_rows
from cairnlog.sources import evaluations as ev
from cairnlog.sources.chunks import read_chunks, write_chunks
from cairnlog.sources.logs import (
    ingest_logs,
    open_or_ingest,
    parse_file_lines,
    read_log_lines,
    with_line_numbers,
)
from cairnlog.steps import ChunkVectors, LogTable, StepRunner

from scans import scanned_rows

BGL = "- {n} 2005.06.03 R0{k} 2005-06-03-15.42.50.{n:06d} R0{k} RAS {c} {l} message {n}"


@pytest.fixture()
def folder(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = [BGL.format(n=n, k=n % 3, c="APP", l="ERROR" if n % 4 == 0 else "INFO") for n in range(400)]
    (logs / "a.log").write_text("\n".join(lines[:250]) + "\n\n  \nshort\n")
    (logs / "b.log").write_bytes(b"t1 INFO generic \xff one\r\nt2 ERROR two\nlonely\n" + "\n".join(lines[250:]).encode())
    (logs / "c.txt").write_text("not read\n")
    (logs / "sub").mkdir()
    (logs / "sub" / "d.log").write_text("not read either\n")
    return logs


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_splits(spark, folder, small_splits):
    lines = with_line_numbers(read_log_lines(spark, str(folder)))
    assert lines.select("file", "split_start").distinct().count() > 6
    found = lines.orderBy("file", "line_no").collect()
    for name in ("a.log", "b.log"):
        text = (folder / name).read_text(encoding="utf-8", errors="ignore").splitlines()
        mine = [r for r in found if r["file"] == name]
        assert [r["value"] for r in mine] == text
        assert [r["line_no"] for r in mine] == list(range(1, len(text) + 1))
    assert {r["file"] for r in found} == {"a.log", "b.log"}


@pytest.mark.parametrize("broadcast_bytes", [32 * 1024 * 1024, 0])
def test_ingest(spark, folder, tmp_path, small_splits, monkeypatch, broadcast_bytes):
    from cairnlog.sources import logs as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", broadcast_bytes)
    out = str(tmp_path / "table")
    # Both passes over the text read each of its lines once.
    stats, lines = scanned_rows(spark, lambda: ingest_logs(spark, str(folder), out).head(), "text")
    assert lines == 2 * (250 + 3 + 3 + 150)
    # b.log starts with a generic line, so all its lines are read as generic ones.
    assert tuple(stats) == (404, 64, 2)
    logs = spark.read.parquet(out).orderBy("id").collect()
    assert [r["id"] for r in logs] == list(range(1, 403))
    assert [r["file_source"] for r in logs] == ["a.log"] * 250 + ["b.log"] * 152
    assert logs[250]["message"] == "generic  one" and logs[250]["component"] == ""
    numbers = [int(r["raw_line"].split()[1]) for r in logs if r["raw_line"].startswith("- ")]
    assert numbers == list(range(400))
    again, reused = open_or_ingest(spark, str(folder), out)
    assert again.count() == 402 and reused.head()["files_processed"] == 0


def test_statistics_of_what_was_written(spark, folder, tmp_path, small_splits):
    for parser, kept, errors in (("per_line", 402, 101), ("bgl", 400, 100), ("hdfs", 0, 0)):
        out = str(tmp_path / parser)
        assert tuple(ingest_logs(spark, str(folder), out, parser).head()) == (404, errors, 2)
        logs = spark.read.parquet(out)
        assert sorted(r["id"] for r in logs.select("id").collect()) == list(range(1, kept + 1))
    first = str(tmp_path / "first")
    ingest_logs(spark, str(folder), first, one_format=True)
    assert spark.read.parquet(first).count() == 400


def test_files_without_lines(spark, tmp_path):
    (tmp_path / "blank.log").write_text("\n  \n\n")
    (tmp_path / "empty.log").write_text("")
    assert tuple(ingest_logs(spark, str(tmp_path), str(tmp_path / "out")).head()) == (0, 0, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_the_first_line_is_judged_as_it_stands(spark, tmp_path):
    line = "2019-03-04 05:06:07.089 INFO nova.x [r] one two"
    (tmp_path / "a.log").write_text(f"  {line}\n{line}\n")
    (tmp_path / "b.log").write_text(f"\n{line}\n")
    (tmp_path / "c.log").write_text(f"{line}\nshort line\n")
    ingest_logs(spark, str(tmp_path), str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out")).groupBy("file_source").count().collect()
    assert {r["file_source"]: r["count"] for r in kept} == {"a.log": 2, "b.log": 1, "c.log": 1}
    parsed = parse_file_lines(spark, str(tmp_path)).where("record is not null")
    assert {r["file"]: r["count"] for r in parsed.groupBy("file").count().collect()} == {
        r["file_source"]: r["count"] for r in kept
    }


def test_a_step_is_prepared_anew_for_other_settings(spark, folder, tmp_path):
    made = []

    def run(**settings):
        step = ChunkVectors(**settings)
        step.run(spark, str(folder), str(tmp_path / "work"))
        made.append(step.out)
        return step.corpus.count()

    counts = [run(size=50), run(size=50), run(size=40), run(size=50, overlap=5), run(size=50, max_chunks=2)]
    assert made[0] == made[1] and len(set(made)) == 4
    assert counts[0] == counts[1] < counts[2] and counts[4] == 2
    (folder / "b.log").write_text("now another file\n")
    assert run(size=50) != counts[0] and len(set(made)) == 5
    table = LogTable()
    assert table.run(spark, str(folder), str(tmp_path / "work")).head()["files_processed"] == 2
    assert table.run(spark, str(folder), str(tmp_path / "work")).head()["files_processed"] == 0
    assert LogTable("bgl").run(spark, str(folder), str(tmp_path / "work")).head()["files_processed"] == 2


def test_parsers_by_name_and_function(spark, folder):
    path = str(folder / "b.log")
    per_line = parse_file_lines(spark, path, "per_line").where(F.col("record").isNotNull())
    assert per_line.where("record.component = 'APP'").count() == 150
    own = parse_with(lambda line: {"level": "X", "timestamp": line[:2]} if line.startswith("t") else None)
    assert parse_file_lines(spark, path, own).where("record.level = 'X'").count() == 2
    assert parse_file_lines(spark, path, "bgl").where("record is not null").count() == 150


def test_one_format_and_block_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("1 2 3 4 5 6 7 8 9 ten words\n")
    (tmp_path / "b.log").write_text("110731 070809 7 INFO dfs.Node: all well\nshort\n")
    kept = lambda **how: parse_file_lines(spark, str(tmp_path), **how).where("record is not null")
    assert kept(one_format=True).count() == 1 and kept().count() == 2
    record = kept(parser="hdfs").select("record.*").head()
    assert tuple(record) == ("110731 070809", "INFO", "dfs.Node", "all well")
    assert ingest_logs(spark, str(tmp_path), str(tmp_path / "out"), one_format=True).head()["total_lines"] == 3


def test_queries_with_comments_and_errors_at_run_time(spark, folder, tmp_path):
    out = str(tmp_path / "table")
    ingest_logs(spark, str(folder), out, "per_line")
    logs = spark.read.parquet(out)
    assert query_logs(logs, "-- first\n/* and\nthen */ ((select 1 AS one))").head()[0] == 1
    failing = "select cast(message as int) from logs"
    assert query_logs(logs, failing, error_rows=True).columns == ["error"]
    assert query_logs(logs, "select level, level from logs", error_rows=True).count() == logs.count()


def test_queries(spark, folder, tmp_path):
    out = str(tmp_path / "table")
    ingest_logs(spark, str(folder), out, "per_line")
    logs = spark.read.parquet(out)
    assert [r["message"] for r in error_logs(logs, 2).collect()] == ["two", "message 396"]
    assert query_logs(logs, "select count(*) n from logs where level = ?", ["ERROR"]).head()[0] == 101
    assert search_logs(logs, "MESSAGE 39_").count() == 10
    for bad in ("drop table logs", "select 1; select 2", "with x as (select 1) insert into logs select * from x", ""):
        assert query_logs(logs, bad, error_rows=True).columns == ["error"]
        with pytest.raises(Exception):
            query_logs(logs, bad)


def test_labels_of_several_files_follow_their_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("BlockId,Label\nblk_1,Anomaly\n")
    (tmp_path / "b.csv").write_text("BlockId,Label\nblk_1,Normal\n" + "".join(f"blk_x{i},Normal\n" for i in range(500)))
    found = {r[0]: r[1] for r in ev.read_labels(spark, str(tmp_path)).collect()}
    assert found["blk_1"] == 0


def test_a_failed_write_is_written_over(spark, tmp_path):
    (tmp_path / "x.log").write_text("2020 INFO all well here\n")
    out = tmp_path / "table"
    out.mkdir()
    (out / "part-0.parquet").write_text("cut off")
    logs, stats = open_or_ingest(spark, str(tmp_path), str(out))
    assert logs.count() == 1 and stats.head()["total_lines"] == 1


def test_labels_and_sessions(spark, tmp_path):
    (tmp_path / "gt.csv").write_text("BlockId,Label\nblk_1,Normal\nblk_2, ANOMALY \nblk_1,Anomaly\nblk_3,odd\n")
    found = {r[0]: r[1] for r in ev.read_labels(spark, str(tmp_path / "gt.csv")).collect()}
    assert found == {"blk_1": 1, "blk_2": 1, "blk_3": 0}
    frame = spark.createDataFrame([("blk_1", "Normal")], "BlockId string, Label string")
    ev.write_labels(frame, str(tmp_path / "out"))
    assert ev.read_labels(spark, str(tmp_path / "out")).head()["expected_label"] == 0
    sessions = tmp_path / "sessions"
    sessions.mkdir()
    (sessions / "blk_-5.log").write_text("\n one\ntwo \n\n")
    assert tuple(ev.read_session_files(spark, str(sessions)).head()) == ("blk_-5", "one\ntwo")


def test_sessions_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """Same rows as by Spark's own readers, which list all files in the driver."""
    texts = {"1/blk_1.log": b"\xef\xbb\xbfone\r\ntwo\rthree\n\n", "1/blk_-2.log": b"", "2/b [3]%20é+,;.log": b" \xff x\n",
             "2/_4.log": b"hidden", "2/.5.log": b"hidden", "2/blk_6.txt": b"other", "1/sub/blk_7.log": b"deeper",
             "2/blk_8.log": b"\n".join(b"line %d" % i for i in range(4_000))}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    monkeypatch.setattr(ev, "WHOLE_BYTES", 20_000)
    monkeypatch.setattr(ev, "BATCH_ROWS", 3)

    def found(path):
        files = ev.read_session_files(spark, path).withColumn("logs", F.hex("logs"))
        return sorted(map(tuple, files.collect())), sorted(map(tuple, ev.read_session_lines(spark, path).collect()))

    (tmp_path / "None").write_text("no session's")
    ours = [found(str(tmp_path / folder)) for folder in ("1", "2")]
    assert found(f"{tmp_path}/*") == tuple(sorted(a + b) for a, b in zip(*ours))
    assert len(ours[1][0]) == 2 and len(ours[1][1]) == 4_001
    plan = ev.read_session_files(spark, str(tmp_path / "1"))
    assert plan.inputFiles() and not any(name.endswith(".log") for name in plan.inputFiles())
    monkeypatch.setattr(ev, "opens", lambda address: False)
    assert [found(str(tmp_path / folder)) for folder in ("1", "2")] == ours
    (tmp_path / "3" / "day=1").mkdir(parents=True)
    (tmp_path / "3" / "day=1" / "blk_9.log").write_text("x")
    monkeypatch.undo()
    assert found(str(tmp_path / "3")) == ([("blk_9", "78")], [("blk_9", 1, "x")])


def test_results_round_trip(spark, tmp_path):
    row = {name: None for name in schemas.RESULT_COLUMNS}
    row |= {"config_name": "c", "correct": True, "time_seconds": 1.5, "tokens_total": 3, "reason": 'a "b", c\nd'}
    frame = spark.createDataFrame([tuple(row.values())], schemas.RESULTS)
    nested = frame.withColumn("expected", F.array(F.lit("x"), F.lit("y")))
    ev.write_results(nested, str(tmp_path / "r1"))
    found = ev.read_results(spark, [str(tmp_path / "r1"), str(tmp_path / "missing")]).collect()
    assert len(found) == 1 and found[0]["correct"] is True and found[0]["time_seconds"] == 1.5
    assert found[0]["expected"] == '["x","y"]' and found[0]["reason"] == 'a "b", c\nd'
    with pytest.raises(ValueError):
        ev.read_results(spark, [str(tmp_path / "missing")])


def test_results_of_many_files_are_one_scan(spark, tmp_path):
    heads = ["question_id,correct,tokens_total", "correct,note,question_id", "question_id"]
    for i in range(300):
        cells = {"question_id": f"q{i}", "correct": "true", "tokens_total": str(i), "note": f'"a\n{i}"'}
        names = heads[i % 3].split(",")
        (tmp_path / f"r{i}.csv").write_text("\n".join([heads[i % 3], ",".join(cells[n] for n in names)]) + "\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(path) for path in tmp_path.glob("*.csv")]
    found, rows = scanned_rows(spark, lambda: ev.read_results(spark, paths).collect(), "csv")
    assert rows == 600 and len(found) == 300
    by = {row["question_id"]: row for row in found}
    for i in range(300):
        row = by[f"q{i}"]
        assert row["tokens_total"] == (i if i % 3 == 0 else None)
        assert row["correct"] == (True if i % 3 < 2 else None) and row["note"] == (f"a\n{i}" if i % 3 == 1 else None)


def test_results_are_parsed_as_wide_as_their_headers(spark, tmp_path):
    def read(name, text):
        (tmp_path / name).write_text(text)
        return ev.read_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / name)]).collect()

    (tmp_path / "a.csv").write_text("question_id,note\nq1,x,too many\nq2\n")
    assert ev._header_width(spark, [str(tmp_path / "a.csv")]) == 2
    found = read("b.csv", '\n  \n"a,b",correct,question_id\n1,true,"q\n3"\n')
    assert ev._header_width(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]) == 4
    assert len(found) >= 3
    found = read("c.csv", '"two\nlines",question_id,z\n7,q4,8\n')
    assert ev._header_width(spark, [str(tmp_path / "c.csv")]) == ev.MAX_COLUMNS
    assert sorted((r["question_id"], r["note"], r["two\nlines"], r["z"]) for r in found) == [
        ("q1", "x", None, None), ("q2", None, None, None), ("q4", None, "7", "8")]


def test_long_sessions_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "blk_1.log").write_text("".join(f"line {i}\n" for i in range(300_000)))
    (tmp_path / "blk_-2.log").write_text("one\ntwo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        lines = ev.read_session_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        assert lines.where("block_id = 'blk_1' and value != concat('line ', line_no - 1)").count() == 0
        assert {r["block_id"]: r["count"] for r in lines.groupBy("block_id").count().collect()} == {"blk_1": 300_000, "blk_-2": 2}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evaluations(spark, tmp_path):
    tests = [{"block_id": f"blk_{i}", "expected_label": i % 2, "predicted_label": 1, "correct": i % 2 == 1} for i in range(25)]
    new = {"metadata": {"experiment": "e1", "model": "m"}, "metrics": {"TP": 12, "f1": 0.5}, "test_results": tests}
    (tmp_path / "eval_b.json").write_text(json.dumps(new, indent=2))
    (tmp_path / "eval_a.json").write_text(json.dumps({"metadata": {"prompt_variant": "old"}, "summary": {"f1": 0.9}}))
    (tmp_path / "other.json").write_text("{}")
    found = ev.read_evaluations(spark, str(tmp_path)).collect()
    found = sorted(found, key=lambda r: r["_filename"])
    assert [r["_filename"] for r in found] == ["eval_a.json", "eval_b.json"]
    assert len(found[1]["test_results"]) == 25
    runs = spark.createDataFrame([("e1", "m")], "experiment string, model string").select(
        "experiment", F.struct("model").alias("metadata"),
        F.expr("named_struct('TP', 1, 'FP', 2, 'TN', 3, 'FN', 4, 'precision', 0.5, 'recall', 0.5, 'f1', 0.5, 'accuracy', 0.5)").alias("metrics"))
    results = spark.createDataFrame([("e1", f"blk_{i}", True) for i in range(25)], "experiment string, block_id string, correct boolean")
    ev.write_evaluation(runs, results, str(tmp_path / "out"))
    again, tests = ev.read_written_evaluation(spark, str(tmp_path / "out"))
    assert comparison_table(again).select("_filename", "model", "FP").collect() == [("e1", "m", 2)]
    assert tests.where("correct").select("block_id").distinct().count() == 25
    assert spark.read.csv(str(tmp_path / "out" / "summary"), header=True).head()["FP"] == "2"


def test_configs(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"name": "a", "preprocessing": True}, {"name": "b", "max_iterations": 3}], indent=1))
    (tmp_path / "one.json").write_text(json.dumps({"name": "c", "task": "t", "use_embeddings": True}, indent=1))
    found = ev.read_experiment_configs(spark, str(tmp_path / "list.json")).orderBy("name").collect()
    assert [(r["use_preprocessing"], r["max_iterations"], r["task"], r["prompts"]) for r in found] == [
        (True, 10, "anomaly_detection", {}), (False, 3, "anomaly_detection", {})]
    one = ev.read_experiment_configs(spark, str(tmp_path / "one.json")).head()
    assert one["task"] == "t" and one["use_embeddings"] is True and one["workflow"] == "simple"


RUN = {
    "session_id": "s1", "task": "t", "config": {"model": "m", "api_key": "secret"}, "duration": 10.0,
    "interactions": [
        {"agent": "lead", "parent": None, "start_time": 0.0, "duration": 10.0, "total_tool_calls": 2, "iterations": [
            {"iteration": 1, "timestamp": 1.0, "response": "r", "tool_calls": [{"name": "grep", "arguments": {"a": 1}, "id": "1"}, {"name": "cat", "arguments": {}, "id": None}],
             "model_info": {"usage": {"input_tokens": 5, "output_tokens": 2, "total_tokens": 7}},
             "tool_call_results": [{"name": "grep", "id": "1", "result": "x"}, {"name": "cat", "id": None, "result": "y"}]}]},
        {"agent": "dev", "parent": "lead", "start_time": 2.0, "iterations": [
            {"iteration": 1, "timestamp": 2.0, "response": "r", "tool_calls": [], "model_info": {"usage": {"input_tokens": 4}}, "tool_call_results": None}]},
    ],
}


def test_run_logs(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps(RUN, indent=2))
    (tmp_path / "s2.json").write_text(json.dumps({"session_id": "s2", "interactions": [], "config": {}}))
    runs = ev.read_run_logs(spark, str(tmp_path))
    rows = runs.orderBy(F.desc("_filename")).collect()
    assert [r["session_id"] for r in rows] == ["s2", "s1"] and rows[1]["config"]["api_key"] == "[REDACTED]"
    inter, iters = interactions_table(runs), iterations_table(runs)
    assert {r["session_id"]: tuple(r)[1:] for r in run_summary(runs, inter).collect()} == {"s1": (10.0, 2, 2, 2), "s2": (0.0, 0, 0, 0)}
    assert tuple(token_usage(iters).head()) == ("s1", 9, 2, 11)
    assert tuple(last_iteration_tokens(inter, iters).head()) == ("s1", 4, 0, 0)
    matched = tool_call_results(tool_calls_table(iters), tool_results_table(iters)).collect()
    assert {(r["name"], r["result"]) for r in matched} == {("grep", "x"), ("cat", "y")}


def test_ground_truth(spark, folder, tmp_path):
    lines = with_line_numbers(read_log_lines(spark, str(folder / "a.log")))
    parsed = parse_lines(lines, "value")
    questions = generate_questions(log_facts(parsed))
    found = {r["id"]: r for r in questions.collect()}
    assert len(found) == 15 and "q4_top3_components" not in found and "q6_warning_count" not in found
    assert found["q1_error_count"]["expected_int"] == 63 and found["q8_error_ratio"]["expected_int"] == 25
    assert found["q5_peak_error_hour"]["expected_list"] == ["15", "hour 15", "15:00"]
    assert found["q11_has_fatal"]["expected_list"] == ["no", "false", "0"]
    meta = spark.createDataFrame([("a.log",)], "file string")
    ev.write_ground_truth(meta, statistics_rows(parsed), questions, str(tmp_path / "gt"))
    assert spark.read.json(str(tmp_path / "gt" / "evaluation_questions")).count() == 15
    empty = generate_questions(log_facts(parsed.where("false"))).collect()
    assert {r["id"] for r in empty} == {"q1_error_count", "q2_total_lines", "q7_level_types", "q9_unique_nodes", "q11_has_fatal"}


def test_steps(spark, folder, tmp_path):
    runner = StepRunner([LogTable("per_line"), ChunkVectors(size=50, overlap=5, max_chunks=6)])
    meta = runner.run(spark, str(folder), str(tmp_path / "work"))
    assert meta["log_table"].head()["total_lines"] == 404
    info = meta["chunk_vectors"].head()
    assert (info["num_chunks"], info["chunk_size"], info["embedding_dim"]) == (6, 50, 256)
    tools = runner.tools()
    assert tools["search_similar"]("message 3 generic", top_k=3).count() == 3
    assert tools["similar_to_chunk"](0, 2).count() == 2
    with pytest.raises(IndexError):
        tools["chunk_by_index"](-1)
    with pytest.raises(IndexError):
        tools["similar_to_chunk"](99)
    assert tools["query_logs"]("select 1 one from logs limit 1").head()[0] == 1
    # A second run reuses both tables.
    again = StepRunner([LogTable("per_line"), ChunkVectors(size=50, overlap=5, max_chunks=6)]).run(spark, str(folder), str(tmp_path / "work"))
    assert again["log_table"].head()["files_processed"] == 0


def test_chunk_files(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "x")], "chunk_index long, chunk string")
    write_chunks(chunks, str(tmp_path / "c"), chunk_size=3, overlap=1, model_name="m")
    found, config = read_chunks(spark, str(tmp_path / "c"))
    assert found.count() == 1 and tuple(config.head()) == (3, 1, "m")


def test_pluggable_encoder(spark):
    import numpy as np

    from cairnlog.operators.chunks import embed_chunks

    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    chunks = spark.createDataFrame([(i, "x" * i) for i in range(70)], "chunk_index long, chunk string")
    found = embed_chunks(chunks, make).collect()
    assert all(abs(r["vec"][0] ** 2 + r["vec"][1] ** 2 - 1) < 1e-5 for r in found)
    assert abs(found[3]["vec"][0] / found[3]["vec"][1] - found[3]["chunk_index"]) < 1e-4
