"""Small intermediate tables on shared storage.

A table written and read back has three uses: a lost executor does not bring its
whole lineage back, a value computed by one pass is the same in the next, and
Catalyst knows its size on disk. The last one makes broadcasts safe without any
hint: below ``spark.sql.autoBroadcastJoinThreshold`` the join is a broadcast, above
it a sort-merge join with AQE skew handling.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    The second is for tests and single machines: a warehouse that each machine of a
    cluster has for itself is no place for tables that others read, and is warned of.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    own_disk = "://" not in warehouse or warehouse.startswith("file:")
    if own_disk and not context.master.startswith("local"):
        warnings.warn(
            f"spark.checkpoint.dir is unset: tables go to {warehouse}, which all executors must share",
            stacklevel=2,
        )
    return f"{warehouse}/_checkpoints"


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` under the shared folder and return a scan of it."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/cairnlog/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
