"""Connected components of links, by alternating large and small stars.

Every round is an aggregation to minima and a join, so that a node with many neighbours
is neither collected nor held by one task. Rounds end when the links stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    upward = both.where(F.col("b") > F.col("a"))
    return upward.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` of every linked node that is not itself its component's smallest.

    ``links`` has ids ``a`` and ``b``; direction and repetition do not matter. A node
    linked with no other one is not listed.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialise(ordered.where(F.col("a") != F.col("b")).distinct(), "links")
    state = None
    while True:
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if (row["n"], row["x"]) == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = (row["n"], row["x"])
        if row["n"]:
            current = materialise(_small_star(_large_star(current)).distinct(), "links")
