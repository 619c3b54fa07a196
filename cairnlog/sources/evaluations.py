"""Labels, session files, result tables, evaluation documents and run logs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.parsing import strip
from ..functions.text import redact_config
from ..plans.durable import materialise
from ..plans.files import dealt, listed, metadata_name, opens, read_whole
from ..plans.numbering import number_scan_rows
from ..plans.shipping import ship_code
from .logs import decoded, log_lines_of, matching_folders, path_exists, read_log_lines, with_line_numbers


def label_flag(label: Column) -> Column:
    """1 for "anomaly" in any case, else 0."""
    return F.when(F.lower(strip(label)) == "anomaly", 1).otherwise(0)


def last_labels(rows: DataFrame, order: str) -> DataFrame:
    """One row per ``BlockId`` with the label of its last row by ``order``."""
    # 2 * order + flag keeps the aggregate on longs; its lowest bit is the label.
    packed = F.max(F.col(order) * 2 + label_flag(F.col("Label")))
    return rows.groupBy(F.col("BlockId").alias("block_id")).agg(
        F.pmod(packed, F.lit(2)).cast("int").alias("expected_label")
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``BlockId,Label`` CSVs as block ids with 0/1; the last row of an id wins, by file name and place."""
    rows = spark.read.csv(path, schema=schemas.LABELS, header=True).select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )
    return last_labels(number_scan_rows(rows, "_row", per_file=False), "_row")


def write_labels(labels: DataFrame, path: str) -> None:
    """Write ``BlockId,Label`` rows as CSV."""
    labels.select("BlockId", "Label").write.csv(path, header=True)


#: Bytes up to which a file's lines are cut by the task that reads it; of longer ones Spark reads splits.
WHOLE_BYTES = 16 * 1024 * 1024
#: Rows and bytes of a batch of texts or lines.
BATCH_ROWS = 10_000
BATCH_BYTES = 8 * 1024 * 1024


def _session_names(spark: SparkSession, path: str) -> DataFrame | None:
    """The ``*.log`` of a folder, or of folders, listed by tasks; None where only Spark's readers can."""
    folders = matching_folders(spark, path)
    if not folders or not all(opens(folder) for folder in folders[:1]):
        return None
    ship_code(spark)
    found = listed(spark, folders, "*.log")
    return None if found.where("inner").head(1) else found


def _batches(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
    names, numbers, values, size = [], [], [], 0
    for name, number, value in rows:
        names.append(name)
        numbers.append(number)
        values.append(value)
        size += len(value)
        if len(names) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _batch(names, numbers, values)
            names, numbers, values, size = [], [], [], 0
    yield _batch(names, numbers, values)


def _batch(names: list[str], numbers: list[int], values: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(values, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["name", "line_no", "value"])


def _contents(files: DataFrame, *, by_line: bool) -> DataFrame:
    """``name, line_no, value`` of files, read by tasks: their texts, or their lines numbered from 1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()):
                data, name = read_whole(f"{folder}/{name}"), metadata_name(name)
                if not by_line:
                    yield name, 0, data
                    continue
                # As Spark's reader of lines does it: \n, \r and \r\n end a line, a mark of UTF-8 is left out.
                for number, line in enumerate(data.removeprefix(b"\xef\xbb\xbf").splitlines(), 1):
                    yield name, number, line

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches))

    return dealt(files).mapInArrow(read, "name string, line_no long, value binary").withColumn(
        "value", F.col("value").cast("string")
    )


def _block_id(name: str) -> Column:
    return F.regexp_replace(name, r"\.log$", "").alias("block_id")


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``<BlockId>.log`` of a folder, or of those a pattern stands for: the id and the stripped text.

    For sessions that fit into a row; ``read_session_lines`` gives those of any size. Tasks
    list and read the files, so the driver knows folders but not files.
    """
    names = _session_names(spark, path)
    if names is None:
        texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.log").select(
            F.col("_metadata.file_name").alias("name"), "value"
        )
    else:
        texts = _contents(names, by_line=False)
    return texts.select(_block_id("name"), strip(F.col("value")).alias("logs"))


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, line_no, value``: the lines of all ``<BlockId>.log`` of a folder, or of several by a pattern.

    Tasks list the files and read short ones; long ones are read split by split.
    """
    names = _session_names(spark, path)
    if names is None:
        lines = with_line_numbers(read_log_lines(spark, path))
        return lines.select(_block_id("file"), "line_no", "value")
    longest = min(WHOLE_BYTES, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    short = _contents(names.where(F.col("size") <= longest), by_line=True).select(
        _block_id("name"), "line_no", decoded(F.col("value")).alias("value")
    )
    # Each of these has many bytes, so there are few.
    long = [f"{row['folder']}/{row['name']}" for row in names.where(F.col("size") > longest).collect()]
    if not long:
        return short
    lines = with_line_numbers(log_lines_of(spark, long))
    return short.unionByName(lines.select(_block_id("name"), "line_no", "value"))


#: Columns of a result file at most.
MAX_COLUMNS = 256


def _header_width(spark: SparkSession, paths: Sequence[str]) -> int:
    """Cells of the longest header at most, from the first line of every file that is not blank.

    Each row is parsed into so many columns. A header that goes on in the next line, or is
    not found at the start of the file, counts as ``MAX_COLUMNS``.
    """
    line = F.col("value")
    # Separators inside quotes count too: the width may be too great, but not too small.
    separators = F.length(line) - F.length(F.replace(line, F.lit(",")))
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    leads = (F.col("_metadata.file_block_start") == 0) & (F.trim(line) != "")
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(leads, F.monotonically_increasing_id()).alias("turn"),
        F.when(quotes % 2 == 0, separators + 1).otherwise(MAX_COLUMNS).alias("width"),
    )
    widths = lines.groupBy("file").agg(F.min_by("width", "turn").alias("width"))
    widest = widths.agg(F.max(F.coalesce("width", F.lit(MAX_COLUMNS)))).first()[0]
    return max(1, min(widest or 1, MAX_COLUMNS))


def read_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Result CSVs as one table; files and folders that do not exist are left out.

    Headers may lack columns, name others, or have them in another order. All files are
    parsed in one scan, without their headers; the first row of a file then tells which
    cell belongs to which column. A scan of the lines before it tells how many cells the
    longest header has. Types come from the schema, other columns are text.
    """
    present = [path for path in paths if path_exists(spark, path)]
    if not present:
        raise ValueError("no valid CSV files found")
    names = [f"c{i}" for i in range(_header_width(spark, present))]
    kind = ", ".join(f"{name} string" for name in names)
    # A quoted cell may hold line ends, so a file is read by one task, in order.
    raw = spark.read.schema(kind).csv(present, multiLine=True, escape='"')
    cells = materialise(
        raw.select(
            F.col("_metadata.file_path").alias("file"),
            F.monotonically_increasing_id().alias("place"),
            F.array(*names).alias("cells"),
        ),
        "result-cells",
    )
    first = cells.groupBy("file").agg(F.min("place").alias("place"))
    headers = materialise(
        cells.join(first, ["file", "place"]).select("file", "place", F.col("cells").alias("header")),
        "result-headers",
    )
    # The names of columns, not what is in them.
    found = headers.select(F.explode(F.array_compact("header")).alias("name")).distinct().collect()
    known = [row["name"] for row in found]
    columns = [name for name in schemas.RESULT_COLUMNS if name in known]
    columns += sorted(set(known) - set(columns))
    types = dict(field.split() for field in schemas.RESULTS.split(", "))
    # Where a column is in a file is looked up once per file, not once per cell.
    places = headers.select(
        "file",
        F.col("place").alias("top"),
        *(
            (F.nullif(F.array_position("header", F.lit(name)), F.lit(0)) - 1).cast("int").alias(f"at{i}")
            for i, name in enumerate(columns)
        ),
    )
    rows = cells.join(places, "file").where(F.col("place") > F.col("top"))
    return rows.select(
        *(
            F.get("cells", F.col(f"at{i}")).try_cast(types.get(name, "string")).alias(name)
            for i, name in enumerate(columns)
        )
    )


def write_results(results: DataFrame, path: str) -> None:
    """Write the fixed result columns as CSV with a header; arrays become JSON."""
    nested = {f.name for f in results.schema if f.dataType.typeName() in ("array", "struct", "map")}
    results.select(
        *(F.to_json(c).alias(c) if c in nested else F.col(c) for c in schemas.RESULT_COLUMNS)
    ).write.csv(path, header=True, escape='"')


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation documents ``eval_*.json`` with their ``_filename``, which gives their order."""
    return (
        spark.read.schema(schemas.EVALUATION)
        .json(path, multiLine=True, pathGlobFilter="eval_*.json")
        .withColumn("_filename", F.col("_metadata.file_name"))
    )


def write_evaluation(runs: DataFrame, test_results: DataFrame, path: str) -> None:
    """Write one JSON row per run, one per test, and the summary as CSV under ``path``.

    ``runs`` has ``experiment``, ``metadata`` and ``metrics``; ``test_results`` has
    ``experiment`` and the test columns. A run of any size is one row and its tests.
    """
    runs.write.json(f"{path}/runs")
    test_results.write.json(f"{path}/tests")
    evaluation_summary(runs).write.csv(f"{path}/summary", header=True)


def read_written_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_evaluation`` has written: runs as ``comparison_table`` takes them, and tests.

    ``_filename`` is the name of the run; tests are like those of ``test_rows``.
    """
    runs = spark.read.schema(f"experiment string, {schemas.EVALUATION}").json(f"{path}/runs")
    tests = spark.read.schema(f"experiment string, {schemas.TEST_COLUMNS}").json(f"{path}/tests")
    return (
        runs.withColumn("_filename", F.col("experiment")),
        tests.select(
            F.col("experiment").alias("run"),
            F.col("experiment").alias("_filename"),
            F.coalesce("block_id", "blk_id", F.lit("unknown")).alias("block_id"),
            "expected_label",
            "predicted_label",
            "correct",
        ),
    )


def stored_tests(runs: DataFrame, test_results: DataFrame) -> DataFrame:
    """Per run: ``total`` of its metrics, and how many tests there are and are correct."""
    counts = test_results.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("correct").alias("correct")
    )
    return runs.select("experiment", F.col("metrics.total").alias("total")).join(
        counts, "experiment", "left"
    )


def evaluation_summary(runs: DataFrame) -> DataFrame:
    """One summary row per run, with the column names of the summary file."""
    return runs.select(
        F.col("experiment").alias("Experiment"),
        F.col("metadata.model").alias("Model"),
        *(F.col(f"metrics.{name}").alias(name) for name in ("TP", "FP", "TN", "FN")),
        F.col("metrics.precision").alias("Precision"),
        F.col("metrics.recall").alias("Recall"),
        F.col("metrics.f1").alias("F1"),
        F.col("metrics.accuracy").alias("Accuracy"),
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Nested run logs with API keys hidden; ``_filename`` gives their order."""
    return (
        spark.read.schema(schemas.RUN_LOG)
        .json(path, multiLine=True, pathGlobFilter="*.json")
        .withColumn("config", redact_config(F.col("config")))
        .withColumn("_filename", F.col("_metadata.file_name"))
    )


def read_experiment_configs(spark: SparkSession, path: str) -> DataFrame:
    """Experiment configurations from a JSON list or a single object, defaults filled."""
    raw = spark.read.schema(schemas.CONFIG).json(path, multiLine=True)
    return fill_config_defaults(raw)


def fill_config_defaults(configs: DataFrame) -> DataFrame:
    """Fill what a configuration leaves out; both spellings of the switches are read."""
    empty = F.create_map().cast("map<string,string>")
    return configs.select(
        "name",
        F.coalesce("task", F.lit("anomaly_detection")).alias("task"),
        "provider",
        "model",
        "pipeline",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("workflow", F.lit("simple")).alias("workflow"),
        F.coalesce("prompts", empty).alias("prompts"),
        F.coalesce("use_preprocessing", "preprocessing", F.lit(False)).alias("use_preprocessing"),
        F.coalesce("use_embeddings", "embeddings", F.lit(False)).alias("use_embeddings"),
        F.coalesce("max_iterations", F.lit(10)).alias("max_iterations"),
        "tools_available",
        "tools_unavailable",
        "agents_available",
    )


def filter_configs(configs: DataFrame, part: str) -> DataFrame:
    """Configurations whose name contains ``part``."""
    return configs.where(F.col("name").contains(part))


def write_ground_truth(
    metadata: DataFrame, statistics: DataFrame, questions: DataFrame, path: str
) -> None:
    """Write the parts of a ground truth as JSON rows under ``path``.

    ``statistics`` is the long form (section, key, subkey, value), so a section with
    very many keys stays many rows.
    """
    metadata.write.json(f"{path}/metadata")
    statistics.write.json(f"{path}/statistics")
    questions.write.json(f"{path}/evaluation_questions")
