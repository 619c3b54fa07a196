"""Log files as line tables, and the ingested ``logs`` table."""

from __future__ import annotations

import re
from collections.abc import Callable
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import (
    FORMATS,
    OPENSTACK_LINE,
    PARSERS,
    fields,
    line_format,
    parse_as,
    parse_auto,
    strip,
)
from ..plans.durable import materialise
from ..plans.numbering import number_scan_rows, pin_splits
from ..plans.once import add_once
from ..plans.prefix import running_totals

#: Bytes of the table of scan splits up to which it is broadcast; beyond, lines are
#: dealt by split and joined by sort-merge.
BROADCAST_BYTES = 32 * 1024 * 1024

_CHANGED = "files or scan splits changed between two passes"


def _hadoop(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    files, location = _hadoop(spark, path)
    return files.exists(location)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, location = _hadoop(spark, path)
    return files.getFileStatus(location).isDirectory()


def matching_folders(spark: SparkSession, path: str, pattern: str = "*.log") -> list[str]:
    """The full addresses of a folder, or of those that ``path`` stands for; none if it stands for such files too."""
    files, location = _hadoop(spark, path)
    found = files.globStatus(location) if not files.exists(location) else [files.getFileStatus(location)]
    folders = [each.getPath().toString() for each in found or [] if each.isDirectory()]
    others = [each.getPath().getName() for each in found or [] if not each.isDirectory()]
    return [] if any(fnmatchcase(name, pattern) for name in others) else folders


def read_log_lines(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """Lines of one file, or of the files directly in a folder whose names fit ``pattern``.

    ``file`` and ``split_start`` say where the line comes from. Bytes that are not
    UTF-8 are dropped. Rows of one split are in file order.
    """
    pin_splits(spark)
    reader = spark.read
    if is_folder(spark, path):
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        decoded(F.col("value")).alias("value"),
    )


def log_lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the given files, whose addresses are ``file``, with the ``name`` of the file."""
    pin_splits(spark)
    # Characters that a pattern of paths would read in another way stand for themselves.
    given = [re.sub(r"([\\\[\]{}*?])", r"\\\1", path) for path in paths]
    return spark.read.text(given).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("split_start"),
        decoded(F.col("value")).alias("value"),
    )


def decoded(value: Column) -> Column:
    # A text scan keeps the bytes as they are; lines of valid UTF-8 are left alone.
    mended = F.replace(F.make_valid_utf8(value), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(mended)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Add the 1-based ``line_no`` of each line in its file."""
    return number_scan_rows(lines, "line_no")


def with_record(lines: DataFrame, record: Column) -> DataFrame:
    """Add ``record``, parsed once per line whatever is filtered or selected later."""
    return add_once(lines, {"record": record})


def _first_format(lines: DataFrame, order: str) -> DataFrame:
    # Order and format share one long: its minimum is found by a hash aggregate, while
    # the text of the first line would need a sort.
    code = F.lit(len(FORMATS) - 1)
    for place, name in enumerate(FORMATS[:-1]):
        code = F.when(F.col("_format") == name, place).otherwise(code)
    packed = F.min(F.col(order) * len(FORMATS) + code)
    first = F.pmod(packed, F.lit(len(FORMATS))).cast("int") + 1
    return (
        lines.select("file", order, line_format(F.col("value")).alias("_format"))
        .groupBy("file")
        .agg(F.element_at(F.array(*map(F.lit, FORMATS)), first).alias("format"))
    )


def detect_formats(lines: DataFrame) -> DataFrame:
    """One row per file: the format of its first line."""
    return _first_format(lines, "line_no")


def parse_detected(lines: DataFrame, *, one_format: bool = False) -> DataFrame:
    """Add ``record``: each line parsed by the format detected for its file.

    ``one_format`` uses the format of the first file (in name order) for all of them.
    """
    formats = detect_formats(lines)
    if one_format:
        chosen = formats.agg(F.min_by("format", "file").alias("format"))
        picked = lines.withColumn("format", chosen.scalar())
    else:
        # One row per file, written once so that Catalyst can check its size.
        picked = lines.join(materialise(formats, "formats"), "file")
    return with_record(picked, parse_as(F.col("format"), F.col("value")))


def _stripped_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        read_log_lines(spark, path, pattern)
        .withColumn("value", strip(F.col("value")))
        .where(F.col("value") != "")
    )


def parse_file_lines(
    spark: SparkSession,
    path: str,
    parser: str | Callable[[Column], Column] = "auto",
    *,
    one_format: bool = False,
    pattern: str = "*.log",
) -> DataFrame:
    """Non-blank lines with ``record`` (null where the parser refuses the line).

    ``parser`` is ``auto`` (by each file's first line), ``per_line`` (first that fits
    each line), a format name (``hdfs`` for block logs), or a column function such as
    ``parse_with(fn)``. With ``one_format`` the first file, in name order, decides for all.
    """
    lines = _stripped_lines(spark, path, pattern)
    if parser != "auto":
        return with_record(lines, _line_parser(parser)(F.col("value")))
    # Only the first row of each first split matters; the scan order inside a split
    # is the file order, so its smallest running id is the first line.
    raw = read_log_lines(spark, path, pattern).where(F.col("split_start") == 0)
    formats = _first_format(raw.withColumn("_seq", F.monotonically_increasing_id()), "_seq")
    formats = materialise(formats, "formats")
    if one_format:
        chosen = formats.agg(F.min_by("format", "file").alias("format")).scalar()
        return with_record(lines, parse_as(chosen, F.col("value")))
    return with_record(lines.join(formats, "file"), parse_as(F.col("format"), F.col("value")))


def _line_parser(parser: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(parser):
        return parser
    return parse_auto if parser == "per_line" else PARSERS[parser]


def _split_facts(
    spark: SparkSession, path: str, parser: str | Callable[[Column], Column], pattern: str
) -> DataFrame:
    """One stored row per scan split, from one pass over the text.

    ``file, split_start, turn`` (the running id of its first line), ``lines`` that are not
    blank, ``kept`` (lines each candidate parser accepts) and ``first`` (the format of its
    first line, as a place in ``FORMATS``). For ``auto`` every format is a candidate.
    """
    raw = read_log_lines(spark, path, pattern).withColumn("_seq", F.monotonically_increasing_id())
    lines = add_once(raw, {"line": strip(F.col("value"))})
    line, filled = F.col("line"), F.col("line") != ""
    if parser == "auto":
        # Both looser formats are a matter of how many fields there are.
        shape = {"openstack": line.rlike(OPENSTACK_LINE), "n_fields": F.size(fields(line, 10))}
        lines = add_once(lines, shape)
        accepted = [F.col("openstack"), F.col("n_fields") >= 10, F.col("n_fields") >= 2]
        openstack = F.when(F.col("value") == line, F.col("openstack")).otherwise(
            F.col("value").rlike(OPENSTACK_LINE)
        )
        code = F.when(openstack, 0).when(F.col("n_fields") >= 10, 1).otherwise(2)
    else:
        record = F.when(filled, _line_parser(parser)(line))
        lines = add_once(lines, {"accepted": record.isNotNull()})
        accepted, code = [F.col("accepted")], F.lit(0)
    # Order and format share one long, as in ``_first_format``.
    packed = F.min(F.col("_seq") * len(FORMATS) + code)
    facts = lines.groupBy("file", "split_start").agg(
        F.min("_seq").alias("turn"),
        F.count_if(filled).alias("lines"),
        F.array(*(F.count_if(filled & fits) for fits in accepted)).alias("kept"),
        F.pmod(packed, F.lit(len(FORMATS))).cast("int").alias("first"),
    )
    return materialise(facts, "split-facts")


def _numbered_splits(facts: DataFrame, one_format: bool) -> DataFrame:
    """``file, split_start, code, before, shift`` of every split, stored.

    ``code`` is the candidate chosen for the file. ``before`` counts the kept lines of all
    earlier splits, by file name; ``shift`` turns the running id of a kept line in a scan
    into its ``id``. A running id is the number of the scan's partition times 2 ** 33 plus
    the kept lines before it in the partition, which the facts tell without a pass.
    """
    first = F.min_by("first", "split_start")
    if one_format:
        opening = F.struct("file", "split_start")
        coded = facts.withColumn("code", facts.agg(F.min_by("first", opening)).scalar())
    else:
        coded = facts.join(facts.groupBy("file").agg(first.alias("code")), "file")
    kept = F.when(F.size("kept") == 1, F.col("kept")[0]).otherwise(F.col("kept")[F.col("code")])
    chosen = materialise(
        coded.select("file", "split_start", "turn", "code", kept.alias("n_kept")), "split-formats"
    )
    partition = F.shiftright("turn", 33)
    within = Window.partitionBy(partition).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    base = F.shiftleft(partition, 33) + F.coalesce(F.sum("n_kept").over(within), F.lit(0))
    placed = running_totals(chosen, ["file", "split_start"], {"before": "n_kept"})
    return materialise(
        placed.select("file", "split_start", "code", "before", (F.col("before") - base + 1).alias("shift")),
        "split-offsets",
    )


def logs_rows(parsed: DataFrame, identity: Column, raw: Column, source: Column) -> DataFrame:
    """Rows of the ``logs`` table from lines with a ``record``."""
    return parsed.where(F.col("record").isNotNull()).select(
        identity.cast("long").alias("id"),
        *(
            F.coalesce(F.col(f"record.{name}"), F.lit("")).alias(name)
            for name in ("timestamp", "level", "component", "message")
        ),
        raw.alias("raw_line"),
        source.alias("file_source"),
    )


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """One row about lines with ``file`` and ``record``: all lines, ERROR records, files."""
    per_file = parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("record.level") == "ERROR").alias("errors"),
    )
    return per_file.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
        F.count(F.lit(1)).alias("files_processed"),
    )


def ingest_logs(
    spark: SparkSession,
    path: str,
    out: str,
    parser: str | Callable[[Column], Column] = "auto",
    *,
    one_format: bool = False,
    pattern: str = "*.log",
) -> DataFrame:
    """Parse log files into a Parquet ``logs`` table and return its one-row statistics.

    Ids are dense and follow the files in name order. Files are sorted inside by level
    and timestamp, so their column statistics serve the usual filters. The text is read
    twice: once for what each scan split holds, which gives formats and ids, and once to
    parse and write it, which gives the statistics.
    """
    facts = _split_facts(spark, path, parser, pattern)
    splits = _numbered_splits(facts, one_format)
    lines = _stripped_lines(spark, path, pattern)
    # A split that the first pass did not see must stop the job, not lose its rows.
    unseen = F.raise_error(F.lit(_CHANGED)).cast("long")
    size = splits.agg(F.sum(F.length("file") + 40)).first()[0] or 0
    keys = ["file", "split_start"]
    if size <= BROADCAST_BYTES:
        # A broadcast keeps the scan's order, in which running ids count.
        joined = lines.join(F.broadcast(splits), keys, "left")
    else:
        joined = lines.withColumn("_line", F.monotonically_increasing_id()).join(splits, keys, "left")
    code, value = F.coalesce("code", unseen), F.col("value")
    if parser == "auto":
        record = parse_as(F.element_at(F.array(*map(F.lit, FORMATS)), code.cast("int") + 1), value)
    else:
        record = _line_parser(parser)(value)
    seen = Observation()
    parsed = with_record(joined, record).observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("record").isNotNull()).alias("kept"),
        F.count_if(F.col("record.level") == "ERROR").alias("errors"),
    )
    kept = parsed.where(F.col("record").isNotNull())
    if size <= BROADCAST_BYTES:
        identity = F.monotonically_increasing_id() + F.coalesce("shift", unseen)
    else:
        # The join has dealt lines by split, so this window moves nothing.
        identity = F.row_number().over(Window.partitionBy(*keys).orderBy("_line")) + F.col("before")
    rows = logs_rows(kept.withColumn("id", identity), F.col("id"), value, F.col("file"))
    # What a failed write has left has no mark of success, and is written over.
    mode = "error" if path_exists(spark, f"{out}/_SUCCESS") else "overwrite"
    rows.sortWithinPartitions("level", "timestamp").write.mode(mode).parquet(out)
    expected = facts.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.count_distinct(F.when(F.col("lines") > 0, F.col("file"))).alias("files"),
    ).first()
    counted = seen.get if expected["lines"] else {"lines": 0, "errors": 0}
    if counted["lines"] != expected["lines"]:
        raise RuntimeError(_CHANGED)
    return spark.createDataFrame(
        [(counted["lines"], counted["errors"], expected["files"])],
        "total_lines long, error_count long, files_processed long",
    )


def table_stats(logs: DataFrame) -> DataFrame:
    """One row about an existing ``logs`` table; no file was processed."""
    return logs.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if(F.col("level") == "ERROR").alias("error_count"),
        F.lit(0).cast("long").alias("files_processed"),
    )


def open_or_ingest(
    spark: SparkSession,
    path: str,
    out: str,
    parser: str | Callable[[Column], Column] = "auto",
) -> tuple[DataFrame, DataFrame]:
    """The ``logs`` table at ``out``, made from ``path`` if absent, and its statistics."""
    if path_exists(spark, f"{out}/_SUCCESS"):
        logs = spark.read.parquet(out)
        return logs, table_stats(logs)
    stats = ingest_logs(spark, path, out, parser)
    return spark.read.parquet(out), stats
