"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a repeated key in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Small tables written by plans.durable.materialise are broadcast by Catalyst
    # itself when their files are below this size, and sort-merge joined above it.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's settings to a session builder; partition counts stay the cluster's."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
