"""Queries over the ``logs`` table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import shared_dir

_BEFORE_QUERY = re.compile(r"(?:\s|\(|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*", re.DOTALL)
_QUERY = re.compile(r"(?:select|with)\b", re.IGNORECASE)


def query_logs(
    logs: DataFrame, sql: str, params: Sequence | None = None, *, error_rows: bool = False
) -> DataFrame:
    """Run one SELECT with ``?`` parameters over the view ``logs``.

    It may begin with comments and parentheses; any other statement is refused. With
    ``error_rows`` the query runs at once, its result is kept in the checkpoint folder,
    and an error, also one that only shows while it runs, gives one row with its
    ``error`` instead of raising.
    """
    spark = logs.sparkSession
    try:
        begin = _BEFORE_QUERY.match(sql).end()
        if not _QUERY.match(sql, begin):
            raise ValueError("only a single SELECT is accepted")
        logs.createOrReplaceTempView("logs")
        # Wrapped as a sub-query, text that is not one query cannot be parsed.
        found = spark.sql(f"SELECT * FROM (\n{sql}\n)", args=list(params or []))
        if error_rows:
            if not spark.sparkContext.getCheckpointDir():
                spark.sparkContext.setCheckpointDir(shared_dir(spark))
            found = found.checkpoint()
        return found
    except (PySparkException, ValueError) as error:
        if not error_rows:
            raise
        return spark.createDataFrame([(str(error),)], "error string")


def error_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    """ERROR entries, newest timestamp text first."""
    return (
        logs.where(F.col("level") == "ERROR").orderBy(F.desc("timestamp"), "id").limit(limit)
    )


def search_logs(logs: DataFrame, keyword: str, limit: int = 100) -> DataFrame:
    """Entries whose message is LIKE %keyword%, any case; ``%`` and ``_`` are wildcards."""
    pattern = "%" + keyword.replace("\\", "\\\\") + "%"
    return logs.where(F.col("message").ilike(pattern)).orderBy("id").limit(limit)


def by_component(logs: DataFrame, component: str) -> DataFrame:
    return logs.where(F.col("component") == component)


def by_level(logs: DataFrame, level: str) -> DataFrame:
    return logs.where(F.col("level") == level)


def total_logs(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total_logs"))


def logs_by_level(logs: DataFrame) -> DataFrame:
    return logs.groupBy("level").agg(F.count(F.lit(1)).alias("count"))


def top_components(logs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent components; equal counts by name."""
    counts = logs.groupBy("component").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "component").limit(k)


def log_stats(logs: DataFrame) -> DataFrame:
    """Total, per-level and top-component counts as rows (metric, key, value)."""
    per_pair = logs.groupBy("level", "component").agg(F.count(F.lit(1)).alias("n"))
    sets = per_pair.groupingSets(
        [[], [F.col("level")], [F.col("component")]], F.col("level"), F.col("component")
    ).agg(F.sum("n").alias("value"), F.grouping_id().alias("gid"))
    # Bits of gid mark the columns summed away: level is bit 1, component bit 0.
    rows = sets.select(
        F.when(F.col("gid") == 3, "total_logs")
        .when(F.col("gid") == 1, "by_level")
        .otherwise("top_components")
        .alias("metric"),
        F.coalesce("level", "component").alias("key"),
        "value",
    )
    top = rows.where(F.col("metric") == "top_components").orderBy(F.desc("value"), "key").limit(10)
    return rows.where(F.col("metric") != "top_components").unionByName(top)
