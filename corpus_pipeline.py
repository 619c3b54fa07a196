"""A training corpus from documents: cleaned, deduplicated, decontaminated and packed.

Every stage takes the documents that the one before it kept and returns documents with
the same columns; the last one returns the packed pieces. Between stages documents are
written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.llm.decontaminate import find_leaks
from cairnlog.llm.frames import fresh_name
from cairnlog.llm.line_dedup import remove_repeated_chunks
from cairnlog.llm.near_dedup import near_duplicates
from cairnlog.llm.packing import assign_sequences, tokenize_pieces
from cairnlog.llm.quality import quality
from cairnlog.llm.queries import table, tokenizer_file
from cairnlog.llm.shipping import ship_code
from cairnlog.llm.storage import new_folder
from cairnlog.plans.durable import materialise


def _with_text(documents: DataFrame, source: str, field: str, columns: list[str]) -> DataFrame:
    """``columns`` with the text of a struct column in place of the document's own."""
    changed = documents.withColumn("text", F.col(f"{source}.{field}"))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast("long"))
    return changed.select(*columns)


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the quality rules go, and so do documents that the rules reject."""
    ship_code(spark)
    name = fresh_name(docs.columns, "quality")
    judged = docs.withColumn(name, quality("text")).where(F.col(f"{name}.kept"))
    return _with_text(judged, name, "cleaned", docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that occurred before go; every document stays."""
    ship_code(spark)
    cleaned, name = remove_repeated_chunks(docs)
    return _with_text(cleaned, name, "text", docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Of rows with the same id and text one stays, too. Rows without an id stay.
    """
    ship_code(spark)
    judged = near_duplicates(docs)
    # Written first: while the ids that go are few, they are broadcast and no text is moved.
    gone = materialise(judged.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    left = docs.join(gone, "doc_id", "left_anti")
    again = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = again.where((F.col("n") > 1) & F.col("doc_id").isNotNull()).select("doc_id")
    if again.limit(1).count():
        copies = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(again, "doc_id", "left_anti").unionByName(copies)
    return left.select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, also those that are most of one."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    gone = materialise(leaks.select("doc_id").distinct(), "leaking-documents")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    ship_code(spark)
    pieces = tokenize_pieces(docs, tokenizer_file("word_bpe_49k.json"))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return digest.join(assign_sequences(pieces), "item_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good_documents),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", remove_leaks),
    ("packing", pack),
]

#: The last stage needs a tokenizer, which DuckDB does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
