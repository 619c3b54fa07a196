"""Preparation steps run in order over one input.

A step keeps its tables in a folder named after a fingerprint of the input files and of its
own parameters. The same input and parameters find the folder again; a changed file, size
or encoder has another one, so what was prepared for something else is never taken.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.chunks import (
    chunk_lines,
    embed_chunks,
    embedding_info,
    search_similar,
    similar_to_chunk,
    with_preview,
)
from .operators.nearest import VectorIndex, build_index, read_index
from .operators.logs import error_logs, log_stats, query_logs, search_logs
from .sources.chunks import read_chunk, read_chunks, write_chunks
from .sources.logs import is_folder, open_or_ingest, path_exists, read_log_lines, with_line_numbers

Tools = dict[str, Callable[..., DataFrame]]


def _named(setting: object) -> object:
    """A setting as it stands in a fingerprint; functions by name and code."""
    if not callable(setting):
        return setting
    code = getattr(setting, "__code__", None)
    body = "" if code is None else f"{code.co_code.hex()} {code.co_consts!r}"
    return [getattr(setting, "__module__", ""), getattr(setting, "__qualname__", type(setting).__name__), body]


def fingerprint(spark: SparkSession, path: str, *settings: object) -> str:
    """A short digest of the log files at ``path`` (names, sizes, times) and of settings."""
    reader = spark.read.format("binaryFile")
    if is_folder(spark, path):
        reader = reader.option("pathGlobFilter", "*.log")
    # Only what the listing tells is read, not the files.
    files = reader.load(path).select(F.xxhash64("path", "length", "modificationTime").alias("file"))
    seen = files.agg(F.count(F.lit(1)), F.bit_xor("file"), F.sum(F.col("file").cast("decimal(38,0)"))).first()
    text = json.dumps([*map(str, seen), *map(_named, settings)])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class Step(Protocol):
    """Prepares an input below a workspace folder and offers queries on the outcome."""

    name: str

    def run(self, spark: SparkSession, path: str, workspace: str) -> DataFrame:
        """Prepare and return metadata of one row."""

    def tools(self) -> Tools:
        """Queries by name."""


class LogTable:
    """Step: ingest log files into a ``logs`` table."""

    name = "log_table"

    def __init__(self, parser: str | Callable = "auto"):
        self.parser = parser
        self.logs: DataFrame | None = None

    def run(self, spark: SparkSession, path: str, workspace: str) -> DataFrame:
        out = f"{workspace}/logs-{fingerprint(spark, path, self.parser)}"
        self.logs, stats = open_or_ingest(spark, path, out, self.parser)
        return stats

    def tools(self) -> Tools:
        return {
            "query_logs": lambda sql, params=None: query_logs(
                self.logs, sql, params, error_rows=True
            ),
            "error_logs": lambda limit=100: error_logs(self.logs, limit),
            "search_logs": lambda keyword, limit=100: search_logs(self.logs, keyword, limit),
            "log_stats": lambda: log_stats(self.logs),
        }


class ChunkVectors:
    """Step: cut log files into chunks and give each a vector."""

    name = "chunk_vectors"

    def __init__(
        self,
        size: int = 100,
        overlap: int = 10,
        max_chunks: int | None = None,
        make_encoder: Callable | None = None,
        model_name: str = "hashed-terms",
    ):
        self.size, self.overlap, self.max_chunks = size, overlap, max_chunks
        self.make_encoder, self.model_name = make_encoder, model_name
        self.corpus: DataFrame | None = None
        self.index: VectorIndex | None = None
        self.info: DataFrame | None = None
        self.out = ""

    def run(self, spark: SparkSession, path: str, workspace: str) -> DataFrame:
        settings = (self.size, self.overlap, self.max_chunks, self.make_encoder, self.model_name)
        self.out = f"{workspace}/chunk_vectors-{fingerprint(spark, path, *settings)}"
        if not path_exists(spark, f"{self.out}/config/_SUCCESS"):
            lines = with_line_numbers(read_log_lines(spark, path))
            chunks = chunk_lines(lines, self.size, self.overlap, first=self.max_chunks or None)
            write_chunks(
                embed_chunks(chunks, self.make_encoder),
                self.out,
                chunk_size=self.size,
                overlap=self.overlap,
                model_name=self.model_name,
            )
        self.corpus, config = read_chunks(spark, self.out)
        if path_exists(spark, f"{self.out}/index/centres/_SUCCESS"):
            self.index = read_index(spark, f"{self.out}/index")
        else:
            self.index = build_index(self.corpus, f"{self.out}/index")
        info = embedding_info(self.corpus)
        for column in config.columns:
            info = info.withColumn(column, config.select(column).scalar())
        self.info = info
        return info

    def _query(self, text: str) -> DataFrame:
        one = self.corpus.sparkSession.createDataFrame([(text,)], "chunk string")
        return embed_chunks(one, self.make_encoder).select("vec")

    def tools(self) -> Tools:
        return {
            "search_similar": lambda text, top_k=5, min_similarity=0.0: with_preview(
                search_similar(self.corpus, self._query(text), top_k, min_similarity, index=self.index)
            ),
            "similar_to_chunk": lambda index, top_k=5: with_preview(
                similar_to_chunk(self.corpus, index, top_k, index=self.index)
            ),
            "chunk_by_index": lambda index: read_chunk(self.corpus.sparkSession, self.out, index),
            "embedding_info": lambda: self.info,
        }


class StepRunner:
    """Runs steps in order and gathers their metadata and tools by name."""

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def run(self, spark: SparkSession, path: str, workspace: str) -> dict[str, DataFrame]:
        return {step.name: step.run(spark, path, workspace) for step in self.steps}

    def tools(self) -> Tools:
        merged: Tools = {}
        for step in self.steps:
            merged.update(step.tools())
        return merged
