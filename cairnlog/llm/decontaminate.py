"""Benchmark items found in documents, by DataFrame functions alone.

A window is as many consecutive words of a document as an item has; a document that is
shorter is one window as a whole. Every place where a document shares a shingle with an
item of some length aligns the two. Moving a window that begins before all alignments
of its shared shingles to the right, or one behind all of them to the left, loses none of
these; and two shingles of one window have alignments less than two lengths apart. So
the best window lies between neighbouring alignments at most that far apart, and all
windows there get a SimHash fingerprint, no others.

Fingerprints are cut into one block more than the radius, so that two of them within the
radius agree in a block. Blocks are joined with nothing but fingerprints and places, the
distance is checked, and what is left is confirmed by the exact similarity of its
weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise
from cairnlog.plans.once import add_once

SHINGLE_WORDS = 5
SIMILAR = 0.75
#: Bits in which fingerprints may differ. At similarity 0.75 about 11 of 64 do.
RADIUS = 23

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Lower-cased words: runs without space, tab, line feed, \\v, \\f and \\r."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all ``size``-word runs by place; none where there are fewer words."""
    last = F.size(words) - size
    places = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(places, lambda at: F.xxhash64(F.slice(words, at, size)))


def fingerprint(shingles: Column) -> Column:
    """The 64-bit SimHash of a bag of hashes; every occurrence counts."""

    def majority(bit: Column) -> Column:
        votes = F.aggregate(
            shingles,
            F.lit(0),
            lambda sum_, x: sum_ + F.getbit(x, bit).cast("int") * 2 - 1,
        )
        return F.when(votes > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

    return F.aggregate(
        F.sequence(F.lit(63), F.lit(0), F.lit(-1)),
        F.lit(0).cast("long"),
        lambda bits, bit: F.shiftleft(bits, 1).bitwiseOR(majority(bit)),
    )


def _blocks(print_: Column, radius: int) -> Column:
    """``radius + 1`` blocks that cover 64 bits, as structs of number and value."""
    count = radius + 1
    cuts = [64 * i // count for i in range(count + 1)]
    return F.array(
        *(
            F.struct(
                F.lit(i).alias("block"),
                F.shiftrightunsigned(print_, cuts[i])
                .bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
                .alias("bits"),
            )
            for i in range(count)
        )
    )


def _weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights; a weight is a number of occurrences."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda sum_, x: sum_
        + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)
    return common / (F.size(a) + F.size(b) - common)


def _aligned(documents: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """``id, text_hash, wanted, m, starts``, stored: where documents align with items.

    ``items`` has the items whose shingles have ``size`` words, ``wanted`` is the number of
    shingles of an item, ``m`` that of the document. ``starts`` are where the item would
    begin in the document, in order. Only places are joined, not what is there.
    """
    seeds = materialise(
        items.select(
            F.size("item_shingles").alias("wanted"), F.posexplode("item_shingles").alias("offset", "seed")
        ).distinct(),
        "item-seeds",
    )
    split = add_once(documents, {"words": _words(F.col("text"))}).select("id", "text_hash", "words")
    rows = add_once(split, {"shingles": _shingles(F.col("words"), size)})
    places = rows.select(
        "id", "text_hash", F.size("shingles").alias("m"), F.posexplode("shingles").alias("pos", "seed")
    )
    hits = places.join(seeds, "seed").select(
        "id", "text_hash", "m", "wanted", (F.col("pos") - F.col("offset")).alias("start")
    )
    # A start is one of fewer places than document and item have together.
    aligned = hits.groupBy("id", "text_hash", "m", "wanted").agg(
        F.array_sort(F.collect_set("start")).alias("starts")
    )
    return materialise(aligned, "alignments")


def _window_starts() -> Column:
    """All starts from an alignment to the next one that is less than two lengths away."""
    reach = 2 * F.col("wanted")
    until = F.transform(
        "starts",
        lambda start, place: F.struct(
            start.alias("a"), F.coalesce(F.try_element_at("starts", place + 2), start).alias("b")
        ),
    )
    ranges = F.transform(
        until, lambda x: F.when(x["b"] - x["a"] < reach, F.sequence(x["a"], x["b"])).otherwise(F.array(x["a"]))
    )
    # Windows that would leave the document are moved to its edge.
    last = F.greatest(F.lit(0), F.col("m") - F.col("wanted"))
    return F.array_distinct(F.transform(F.flatten(ranges), lambda x: F.greatest(F.lit(0), F.least(x, last))))


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    similar: float = SIMILAR,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document and item found in it, with the most similar window.

    ``<id>, <item>, start_word, n_words, similarity, distance``; of equally similar windows
    the first. ``distance`` is that of the fingerprints that found it. Words are compared in lower case. A document with fewer words than an item is
    compared as a whole. Items with fewer than five words are one shingle, which shorter
    documents do not hold. Null and empty texts hold nothing, null and empty items are
    found nowhere. Repeated rows give one row for each pair of ids; rows with a null id
    share one. Other columns are ignored.
    """
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    given = benchmark.select(F.col(item_column).alias("item"), F.col(item_text_column).alias("text"))
    words = add_once(given, {"words": _words(F.col("text"))}).drop("text").where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(SHINGLE_WORDS)).alias("length")
    # At most SHINGLE_WORDS rows; without an item one size does for the empty result.
    sizes = sorted(row["length"] for row in words.select(length).distinct().collect()) or [SHINGLE_WORDS]
    found = None
    for size in sizes:
        fits = F.size("words") >= size if size == SHINGLE_WORDS else F.size("words") == size
        hashed = {"item_shingles": _shingles(F.col("words"), size)}
        items = add_once(words.where(fits), hashed).select("item", "item_shingles")
        part = _matches(docs, items, size, similar, radius)
        found = part if found is None else found.unionByName(part)
    best = F.max_by(
        F.struct("start_word", "n_words", "similarity", "distance"),
        F.struct("similarity", -F.col("start_word")),
    )
    return found.groupBy("id", "item").agg(best.alias("best")).select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), "best.*"
    )


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["text_hash"] == right["text_hash"])


def _candidates(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """``id, text_hash, start, wanted, m, item, distance`` of windows and items of one length whose
    fingerprints differ in ``radius`` bits at most. Both sides are fingerprints and names."""
    left = windows.select("*", F.inline(_blocks(F.col("print"), radius)))
    right = items.select("*", F.inline(_blocks(F.col("item_print"), radius)))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # Of the blocks in which a pair agrees only the first one speaks for it.
    agree = F.array_position(
        F.zip_with(
            _blocks(F.col("print"), radius),
            _blocks(F.col("item_print"), radius),
            lambda x, y: x["bits"] == y["bits"],
        ),
        True,
    )
    return (
        left.join(right, ["wanted", "block", "bits"])
        .where(distance <= radius)
        .where(agree == F.col("block") + 1)
        .select("id", "text_hash", "start", "wanted", "m", "item", distance.alias("distance"))
    )


def _matches(
    documents: DataFrame, items: DataFrame, size: int, similar: float, radius: int
) -> DataFrame:
    aligned = _aligned(documents, items, size)
    # A document with a smaller part of an item's shingles cannot be that similar.
    aligned = aligned.where(F.col("m") >= similar * F.col("wanted"))
    # The few documents that share a shingle with an item are split again.
    named = aligned.select("id", "text_hash").distinct()
    again = documents.join(named, _same_document(documents, named), "left_semi").distinct()
    split = add_once(again, {"words": _words(F.col("text"))}).select("id", "text_hash", "words")
    shingled = materialise(
        add_once(split, {"shingles": _shingles(F.col("words"), size)}).select("id", "text_hash", "shingles"),
        "aligned-documents",
    )
    starts = aligned.select("id", "text_hash", "m", "wanted", F.explode(_window_starts()).alias("start"))
    placed = starts.join(
        shingled.withColumnRenamed("id", "d_id").withColumnRenamed("text_hash", "d_hash"),
        F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")),
    )
    window = F.slice("shingles", F.col("start") + 1, F.least("wanted", "m"))
    marked = add_once(placed, {"print": fingerprint(window)}).select(
        "id", "text_hash", "m", "wanted", "start", "print"
    )
    known = add_once(items, {"item_print": fingerprint(F.col("item_shingles"))})
    prints = known.select("item", F.size("item_shingles").alias("wanted"), "item_print")
    near = _candidates(marked, prints, radius)
    pairs = near.join(
        shingled.withColumnRenamed("id", "d_id").withColumnRenamed("text_hash", "d_hash"),
        F.col("id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")),
    ).join(items, "item")
    similar_window = _weighted_similarity(window, F.col("item_shingles"))
    alike = add_once(pairs, {"similarity": similar_window}).where(F.col("similarity") >= similar)
    best = alike.groupBy("id", "text_hash", "item").agg(
        F.max_by(F.struct("start", "distance"), F.struct("similarity", -F.col("start"))).alias("best"),
        F.max("similarity").alias("greatest"),
        *(F.first(name).alias(name) for name in ("m", "wanted", "shingles", "item_shingles")),
    )
    # As similar a window may begin before the first alignment, where it gains nothing.
    earliest = F.greatest(F.lit(0), F.col("best.start") - F.col("wanted") + 1)
    leads = best.withColumn("start", F.explode(F.sequence(earliest, F.col("best.start"))))
    ties = add_once(leads, {"similarity": similar_window}).where(F.col("similarity") >= F.col("greatest"))
    return ties.select(
        "id",
        "item",
        F.col("start").alias("start_word"),
        (F.least("wanted", "m") + size - 1).alias("n_words"),
        "similarity",
        F.col("best.distance").alias("distance"),
    )
