"""Stored chunks: text, metadata and the settings they were made with.

Chunks lie in folders of consecutive numbers, sorted inside. So the folder of a number
is known without a look at the table: a reader of some chunks scans their folders only,
and Parquet's statistics lead it to the row groups that hold them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Consecutive chunk numbers of one folder.
CHUNKS_PER_PART = 16_384


def write_chunks(
    chunks: DataFrame,
    path: str,
    *,
    chunk_size: int,
    overlap: int,
    model_name: str,
    per_part: int = CHUNKS_PER_PART,
) -> None:
    """Write chunks (with or without vectors) and their settings under ``path``.

    A column ``chunk_part`` is added: the chunk's number over ``per_part``.
    """
    parted = chunks.withColumn("chunk_part", F.floor(F.col("chunk_index") / per_part))
    dealt = parted.repartition("chunk_part").sortWithinPartitions("chunk_part", "chunk_index")
    dealt.write.partitionBy("chunk_part").parquet(f"{path}/chunks")
    settings = chunks.sparkSession.range(1).select(
        F.lit(chunk_size).alias("chunk_size"),
        F.lit(overlap).alias("overlap"),
        F.lit(model_name).alias("model_name"),
        F.lit(per_part).alias("per_part"),
        F.lit(parted.schema.json()).alias("columns"),
    )
    settings.write.parquet(f"{path}/config")


def _table(spark: SparkSession, path: str) -> DataFrame:
    # An empty table has no folder to infer columns from.
    columns = spark.read.parquet(f"{path}/config").first()["columns"]
    return spark.read.schema(StructType.fromJson(json.loads(columns))).parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and their one-row settings."""
    config = spark.read.parquet(f"{path}/config").drop("per_part", "columns")
    return _table(spark, path).drop("chunk_part"), config


def read_chunk_range(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """Chunks numbered ``first`` up to ``end``; only the folders that hold them are scanned."""
    per_part = spark.read.parquet(f"{path}/config").first()["per_part"]
    parts = F.col("chunk_part").between(max(first, 0) // per_part, max(end - 1, -1) // per_part)
    number = F.col("chunk_index")
    return _table(spark, path).where(parts & (number >= first) & (number < end)).drop("chunk_part")


def read_chunk(spark: SparkSession, path: str, index: int) -> DataFrame:
    """One chunk with its metadata; a number that no chunk has is an error."""
    found = read_chunk_range(spark, path, index, index + 1)
    if index < 0 or found.isEmpty():
        raise IndexError(f"chunk index {index} out of range")
    return found
