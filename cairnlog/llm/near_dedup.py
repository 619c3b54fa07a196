"""Near-duplicates by min-max hashing, confirmed on whole shingle sets.

Every hash function gives two signature values, its smallest and its largest value over
the set, so half as many functions are evaluated. Bands of four values make buckets.
Documents with equal sets are one class from the start; only one of each class goes on.

In a bucket every document is compared with the bucket's leader, the one that shares
most buckets with others. Links found so far make components, and only buckets that
still hold several components are looked at again: their documents are compared block
by block inside tasks, which give no more than one link for two components that meet.
So no bucket is expanded into rows of pairs, and no link that could still join two
components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise

from .components import connected_components
from .shingles import lowered_words, mix, shingle_set
from .shipping import ship_code, tidied

SHINGLE_WORDS = 5
#: Hash functions; each gives a minimum and a maximum.
FUNCTIONS = 64
#: Values of a band: 32 bands of 4 miss a pair at similarity 0.75 once in 190,000.
BAND = 4
#: Similarity in percent from which documents are linked.
SIMILAR = 75
#: Members of a leader compared by one task.
MEMBERS_PER_TASK = 2_000

#: Members of a family in one block.
BLOCK_MEMBERS = 256

_MULTIPLIERS = mix(np.arange(1, FUNCTIONS + 1, dtype="u8")) | np.uint64(1)
_ADDENDS = mix(np.arange(FUNCTIONS + 1, 2 * FUNCTIONS + 1, dtype="u8"))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of all hash functions, then their maxima; of a set that is not empty."""
    low = np.full(FUNCTIONS, np.iinfo("u8").max, "u8")
    high = np.zeros(FUNCTIONS, "u8")
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * _MULTIPLIERS + _ADDENDS
        values ^= values >> np.uint64(32)
        low = np.minimum(low, values.min(axis=0))
        high = np.maximum(high, values.max(axis=0))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; equal keys mean equal values in the same band."""
    bands = values.reshape(-1, BAND)
    keys = mix(np.arange(len(bands), dtype="u8"))
    for place in range(BAND):
        keys = mix(keys ^ bands[:, place]) + np.uint64(place)
    return keys.view("i8")


def linked(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """Whether two sorted sets have a similarity of at least ``similar`` percent."""
    if not len(a) or not len(b):
        return False
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= similar * (len(a) + len(b) - common)


def _signatures(rows: DataFrame) -> DataFrame:
    """``id, n_shingles, digest, bands`` of every row, stored."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, digests, bands = [], [], []
            for text in batch["text"]:
                shingles = shingle_set(lowered_words(text), SHINGLE_WORDS)
                counts.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                bands.append(band_keys(signature(shingles)) if len(shingles) else None)
            yield pd.DataFrame(
                {"id": batch["id"], "n_shingles": counts, "digest": digests, "bands": bands}
            )

    return materialise(
        rows.mapInPandas(tidied(sign), "id long, n_shingles long, digest binary, bands array<long>"),
        "signatures",
    )


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, stored.

    Pairs with the same ``b`` meet in one task, up to ``MEMBERS_PER_TASK`` of them; a
    ``b`` with more is dealt to several tasks and its set goes to each.
    """
    dealt = pairs.withColumn(
        "salt",
        F.pmod(
            F.xxhash64("a"), F.ceil(F.col("members") / F.lit(MEMBERS_PER_TASK)).cast("long")
        ).cast("int"),
    )
    own = dealt.join(sets.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "shingles")
    leading = (
        dealt.select("b", "salt")
        .distinct()
        .join(sets.withColumnRenamed("id", "b"), "b")
        .select("b", "salt", F.lit(None).cast("long").alias("a"), "shingles")
    )
    # Sorted so that each (b, salt) begins with the set of b, where a is null.
    together = (
        own.unionByName(leading)
        .repartition("b", "salt")
        .sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader = np.zeros(0, "u8")
        for batch in batches:
            found = []
            for a, b, raw in zip(batch["a"].tolist(), batch["b"].tolist(), batch["shingles"]):
                shingles = np.frombuffer(raw, "<u8")
                if a is None or a != a:
                    leader = shingles
                elif linked(shingles, leader):
                    found.append((int(a), b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return materialise(together.mapInPandas(tidied(compare), "a long, b long"), "near-links")


def near_duplicates(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``<id>, n_shingles, component_id, kept`` for every row.

    Documents are linked at a Jaccard similarity of ``SIMILAR`` percent of their sets of
    five-word shingles, words in lower case (A-Z). ``component_id`` is the smallest id
    that can be reached. Null and empty texts have an empty set and no link. Rows with a
    null id are left alone: component null, kept. Rows that share an id are one document:
    what one of their texts is linked with, the id is linked with. Other columns are
    ignored. Ids must be integers.
    """
    ship_code(documents.sparkSession)
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    signed = _signatures(rows)
    filled = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = materialise(
        filled.groupBy("digest").agg(F.min("id").alias("class"), F.first("bands").alias("bands")),
        "set-classes",
    )
    entries = classes.select("class", F.explode("bands").alias("key"))
    sizes = (
        entries.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > 1)
    )
    shared = materialise(entries.join(sizes, "key"), "bucket-members")
    candidates = shared.groupBy("class").agg(F.sum("size").alias("weight"))
    candidates = materialise(candidates, "bucket-weights")
    sets = materialise(
        _sets(rows.join(candidates.select(F.col("class").alias("id")), "id", "left_semi")),
        "candidate-sets",
    )
    # A text that others were copied from shares more buckets than its copies do.
    weighed = shared.join(candidates, "class")
    leaders = weighed.groupBy("key").agg(
        F.max_by("class", F.struct("weight", -F.col("class"))).alias("leader")
    )
    stars = (
        shared.join(leaders, "key")
        .where(F.col("class") != F.col("leader"))
        .groupBy(F.col("class").alias("a"), F.col("leader").alias("b"))
        .agg(F.count(F.lit(1)).alias("bands"))
    )
    # First the leader that shares most buckets; families see to all others.
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("bands", -F.col("b"))).alias("b"))
    links = _confirm(_with_members(materialise(best, "best-leaders")), sets)
    found = connected_components(links)
    links = links.unionByName(_confirm_families(_families(shared.join(leaders, "key"), found), sets))
    found = connected_components(links)

    component = classes.join(found, F.col("class") == F.col("node"), "left").select(
        "digest", F.coalesce("component", "class").alias("component_id")
    )
    return (
        signed.join(component, "digest", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn(
            "kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True))
        )
    )


def _sets(rows: DataFrame) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(lowered_words(text), SHINGLE_WORDS).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "shingles": sets})

    return rows.mapInPandas(tidied(build), "id long, shingles binary")


def _with_members(pairs: DataFrame) -> DataFrame:
    """Pairs with the number of pairs that share ``b``."""
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("members"))
    return pairs.select("a", "b").join(counts, "b")


def _families(led: DataFrame, found: DataFrame) -> DataFrame:
    """``leader, class, part`` of the buckets that hold more than one component.

    Buckets with one leader are one family: most of them hold the same documents.
    """
    member = led.join(found, F.col("class") == F.col("node"), "left").select(
        "key", "leader", "class", F.coalesce("component", "class").alias("part")
    )
    mixed = (
        member.groupBy("key")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where(F.col("low") < F.col("high"))
    )
    kept = member.join(mixed.select("key"), "key").select("leader", "class", "part").distinct()
    return materialise(kept, "families")


def _dealt_to_blocks(families: DataFrame, members: int | None = None) -> DataFrame:
    """``leader, class, part, block, other``: every member with each block it has to meet.

    A component with a block's number of members has blocks of its own, the members of
    smaller ones share blocks. Blocks of one component need not meet each other, so a set
    goes only where sets of other components are: with a million copies and one outlier
    every copy goes to the outlier's block, and nowhere else.
    """
    members = members or BLOCK_MEMBERS
    sizes = families.groupBy("leader", "part").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") >= members, F.col("part"))
    cells = sizes.groupBy("leader", own.alias("cell")).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("blocks", F.ceil(F.col("n") / members).cast("int"))
    # One row for each large component of a family and one for all small ones.
    in_order = Window.partitionBy("leader").orderBy("cell")
    before = F.sum("blocks").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = cells.select(
        F.col("leader").alias("of_leader"),
        "cell",
        "blocks",
        F.coalesce(before, F.lit(0)).cast("int").alias("base"),
        F.sum("blocks").over(Window.partitionBy("leader")).cast("int").alias("total"),
    )
    large = materialise(placed, "family-cells")
    parts = materialise(
        sizes.select(F.col("leader").alias("of_leader"), F.col("part").alias("of_part"), own.alias("of_cell")).join(
            large, ["of_leader"]
        ).where(F.col("of_cell").eqNullSafe(F.col("cell"))),
        "family-parts",
    )
    member = families.join(
        parts, (F.col("leader") == F.col("of_leader")) & (F.col("part") == F.col("of_part"))
    )
    own_block = F.col("base") + F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    all_blocks = F.sequence(F.lit(0), F.col("total") - 1)
    others = F.when(F.col("cell").isNull(), all_blocks).otherwise(
        F.filter(all_blocks, lambda b: (b < F.col("base")) | (b >= F.col("base") + F.col("blocks")))
    )
    return member.select("leader", "class", "part", own_block.alias("block"), F.explode(others).alias("other"))


def _confirm_families(families: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join components inside a family, stored.

    A family is cut into blocks; a group is a pair of blocks, so none is larger than two
    of them. In a group whole sets are compared, unless their components have already
    met there; what leaves it is one link for every two components that meet.
    """
    dealt = _dealt_to_blocks(families).select(
        "leader",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "class",
        "part",
    )
    rows = dealt.join(sets.withColumnRenamed("id", "class"), "class")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["class"].tolist()
        sets_ = [np.frombuffer(raw, "<u8") for raw in group["shingles"]]
        sides = group["block"].to_numpy()
        return pd.DataFrame(
            meeting_links(ids, group["part"].tolist(), sides, sets_),
            columns=["a", "b"],
            dtype="int64",
        )

    return materialise(
        rows.groupBy("leader", "i", "j").applyInPandas(compare, "a long, b long"), "near-links"
    )


def meeting_links(
    ids: list[int], parts: list[int], sides: np.ndarray, sets_: list[np.ndarray], similar: int = SIMILAR
) -> list[tuple[int, int]]:
    """One link for every two parts that meet between the sides, or inside a single one."""
    root = {part: part for part in parts}

    def find(part: int) -> int:
        while root[part] != part:
            root[part] = root[root[part]]
            part = root[part]
        return part

    first = np.flatnonzero(sides == sides.min())
    second = np.flatnonzero(sides != sides.min())
    second = second if len(second) else first
    flat = np.concatenate([sets_[i] for i in second])
    sizes = np.array([len(sets_[i]) for i in second])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    links = []
    for i in first.tolist():
        if all(find(parts[i]) == find(parts[j]) for j in second.tolist()):
            continue
        mine = sets_[i]
        place = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        common = np.add.reduceat((mine[place] == flat).astype("i8"), starts)
        near = 100 * common >= similar * (len(mine) + sizes - common)
        for j in second[near].tolist():
            a, b = find(parts[i]), find(parts[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links
