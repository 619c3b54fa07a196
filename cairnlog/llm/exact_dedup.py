"""Exact duplicates by tree-merging sorted runs of digests, by DataFrame functions alone.

Every input partition is a run: its texts are read once and leave a row with a 64-bit
digest, a SHA-256 and an id. Runs are the leaves of a tree. A round takes ``ROUND_BITS``
binomial steps at once: the runs whose numbers differ in these bits only exchange their
entries, which are merged in digest order. Entries of one digest are the same text only
if length and SHA-256 agree, too; of those the smallest id stays, with their number.
After the last round one run is left. What it found goes back the way it came, from each
run to those it was merged from, and in the end to the documents. So a text that a third
of all documents hold is one entry per run on the way up and one per run on the way
down, and no task ever joins all of its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise
from cairnlog.plans.once import add_once

from .frames import fresh_name

#: Binomial steps of a round: 2 ** 4 runs are merged into one.
ROUND_BITS = 4

_SPACE = r"[\x20\x09-\x0D]+"
_TEXT = ("digest", "length", "sha")


def normalised(text: Column) -> Column:
    """The text with every run of space, tab, \\n, \\v, \\f and \\r as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def _digests(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``row, run, id, digest, length, sha`` of every row, stored."""
    given = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.col(id_column).alias("id"),
        F.col(text_column).cast("string").alias("text"),
    )
    one = add_once(given, {"plain": normalised(F.col("text"))})
    return materialise(
        one.select(
            "row",
            "run",
            "id",
            F.xxhash64("plain").alias("digest"),
            F.octet_length("plain").alias("length"),
            F.unhex(F.sha2("plain", 256)).alias("sha"),
        ),
        "text-digests",
    )


def _merged(entries: DataFrame, bits: int) -> DataFrame:
    """The runs that ``bits`` fewer bits tell apart, each merged from its parts, stored."""
    return materialise(
        entries.groupBy(F.shiftright("run", bits).alias("run"), *_TEXT).agg(
            F.min("least").alias("least"), F.sum("n").alias("n")
        ),
        "merged-runs",
    )


def exact_duplicates(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    round_bits: int = ROUND_BITS,
) -> DataFrame:
    """``<id>, keep_id, group_size, kept, text_sha256`` for every row.

    Texts are the same if they are identical once runs of white space are one space;
    null counts as empty. Of the rows of a text the one with the smallest id stays
    (``kept``), ``keep_id`` is its id. Rows without an id come after all others: they stay
    only where no row of the text has one. Of rows that share id and text one stays. Other
    columns are ignored; an empty table gives no rows. Ids may be of any ordered type.
    """
    signed = _digests(documents, id_column, text_column)
    top = signed.agg(F.max("run")).first()[0] or 0
    least = F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")
    levels = [_merged(signed.withColumn("least", least).withColumn("n", F.lit(1).cast("long")), round_bits)]
    while top >> (round_bits * len(levels)):
        levels.append(_merged(levels[-1], round_bits))
    groups = levels[-1].where(F.col("n") > 1)
    for part in reversed(levels[:-1]):
        groups = _handed_down(part.select("run", *_TEXT), groups, round_bits, "inner")
        groups = materialise(groups, "known-groups")
    judged = _handed_down(signed, groups, round_bits, "left")
    alone = F.col("n").isNull()
    return judged.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("least.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _handed_down(rows: DataFrame, groups: DataFrame, bits: int, how: str) -> DataFrame:
    """``rows`` of finer runs with ``least`` and ``n`` of their groups of coarser runs."""
    known = groups.select(F.col("run").alias("above"), *_TEXT, "least", "n")
    parted = rows.withColumn("above", F.shiftright("run", bits))
    return parted.join(known, ["above", *_TEXT], how).drop("above")


def without_duplicates(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each text, with all its columns: the row that ``exact_duplicates`` keeps."""
    judged = exact_duplicates(documents, id_column=id_column, text_column=text_column)
    sha = fresh_name(documents.columns, "text_sha256")
    id_ = fresh_name(documents.columns, "kept_id")
    stays = judged.where("kept").select(F.col(id_column).alias(id_), F.col("text_sha256").alias("_sha"))
    plain = normalised(F.col(text_column).cast("string"))
    same = F.col(id_column).eqNullSafe(F.col(id_)) & (F.col(sha) == F.col("_sha"))
    left = documents.withColumn(sha, F.sha2(plain, 256)).join(stays, same, "left_semi")
    # Rows that share id and text came through together.
    often = judged.groupBy(F.col(id_column).alias(id_), F.col("text_sha256").alias("_sha")).agg(
        F.count(F.lit(1)).alias("n")
    )
    often = often.where(F.col("n") > 1).select(id_, "_sha")
    if often.limit(1).count():
        copies = left.join(often, same, "left_semi").dropDuplicates([id_column, sha])
        left = left.join(often, same, "left_anti").unionByName(copies)
    return left.drop(sha)
