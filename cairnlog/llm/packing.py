"""Documents packed into sequences of bounded length by hierarchical best fit.

Every partition packs its own pieces, longest first, each into the fullest open bin that
still takes it. Nearly full bins are done. The others become items themselves: they are
dealt to fewer partitions and packed again, as long as a round closes or joins a fair
share of them. No task ever sees more than ``ITEMS_PER_TASK`` items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise

from .shipping import ship_code, tidied
from .tokenizer import encoder

CAPACITY = 2048
ITEMS_PER_TASK = 50_000
#: Free places up to which a bin counts as full.
SLACK = 4
#: A further round must lower the number of open bins by this share.
WORTHWHILE = 0.02


def tokenize_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One stored row per piece: ``item_id, <id>, piece, start, length, ids``.

    A document's ids end with ``end_id``. Only documents longer than ``capacity`` are
    cut, into pieces of ``capacity`` and a shorter last one. A null text is an empty
    one; it still has its end id. Repeated rows are documents of their own, told apart
    by ``item_id``. ``ids`` are little-endian unsigned 32-bit integers.
    """
    ship_code(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all = encoder(tokenizer_path).encode_all
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            places: list[int] = []
            out: list[tuple[int, int, int, bytes]] = []
            for place, ids in enumerate(encode_all(batch["text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    places.append(place)
                    out.append((piece, at // 4, len(part) // 4, part))
            frame = pd.DataFrame(out, columns=["piece", "start", "length", "ids"])
            frame.insert(0, "id", batch["id"].take(places).reset_index(drop=True))
            yield frame

    cut = rows.mapInPandas(tidied(pieces), f"id {kind}, piece int, start long, length long, ids binary")
    stored = materialise(cut.withColumn("item_id", F.monotonically_increasing_id()), "token-pieces")
    return stored.withColumnRenamed("id", id_column)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, longest items first, and the number of bins.

    Open bins are kept by free places; one bit per number of free places tells which
    numbers occur, so the tightest bin is the lowest set bit from the item's length up.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), "int64")
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    occupied = 0
    opened = 0
    for item in order.tolist():
        length = int(lengths[item])
        fitting = occupied >> length
        if fitting:
            free = length + ((fitting & -fitting).bit_length() - 1)
            chosen = by_free[free].pop()
            if not by_free[free]:
                occupied ^= 1 << free
        else:
            free, chosen, opened = capacity, opened, opened + 1
        bins[item] = chosen
        left = free - length
        if left:
            by_free[left].append(chosen)
            occupied |= 1 << left
    return bins, opened


_BINS = "used long, ids array<long>, offsets array<long>"


def _pack_round(items: DataFrame, partitions: int, capacity: int) -> DataFrame:
    """The bins of each partition merged into fuller bins of the same shape."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [batch for batch in batches if len(batch)]
        if not frames:
            return
        own = pd.concat(frames, ignore_index=True).sort_values(["used", "tie"], ignore_index=True)
        bins, opened = best_fit(own["used"].to_numpy(), capacity)
        used = [0] * opened
        ids: list[list[np.ndarray]] = [[] for _ in range(opened)]
        offsets: list[list[np.ndarray]] = [[] for _ in range(opened)]
        for chosen, size, own_ids, own_offsets in zip(
            bins.tolist(), own["used"].tolist(), own["ids"], own["offsets"]
        ):
            ids[chosen].append(own_ids)
            offsets[chosen].append(own_offsets + used[chosen])
            used[chosen] += size
        for at in range(0, opened, 5_000):
            part = slice(at, at + 5_000)
            yield pd.DataFrame(
                {
                    "used": used[part],
                    "ids": [np.concatenate(x) for x in ids[part]],
                    "offsets": [np.concatenate(x) for x in offsets[part]],
                }
            )

    dealt = items.withColumn("tie", F.xxhash64(F.col("ids")[0])).repartition(partitions, "tie")
    return dealt.mapInPandas(tidied(pack), _BINS)


def assign_sequences(
    pieces: DataFrame,
    *,
    capacity: int = CAPACITY,
    items_per_task: int = ITEMS_PER_TASK,
    slack: int = SLACK,
) -> DataFrame:
    """``item_id, sequence_id, offset`` for every row of ``pieces`` (item_id, length).

    Offsets of a sequence are gapless from 0 and its lengths sum up to ``capacity`` at
    most. Sequence ids are arbitrary. No piece gives no sequence; a length above
    ``capacity`` or below 1 is refused. Item ids must differ.
    """
    wrong = F.raise_error(F.lit("a piece is empty or longer than a sequence")).cast("long")
    length = F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(wrong)
    waiting = pieces.select(
        length.alias("used"),
        F.array("item_id").alias("ids"),
        F.array(F.lit(0).cast("long")).alias("offsets"),
    )
    is_full = F.col("used") >= capacity - slack
    done = [waiting.where(is_full)]
    waiting = waiting.where(~is_full)
    count = waiting.count()
    while count:
        partitions = -(-count // items_per_task)
        packed = materialise(_pack_round(waiting, partitions, capacity), "packed-bins")
        left = packed.where(~is_full).count()
        last = partitions == 1 or left > (1 - WORTHWHILE) * count
        done.append(packed if last else packed.where(is_full))
        waiting, count = packed.where(~is_full), 0 if last else left
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    # A bin is named after its first item, so names never meet.
    placed = whole.select(
        F.col("ids")[0].alias("sequence_id"), F.inline(F.arrays_zip("ids", "offsets"))
    )
    return placed.select(F.col("ids").alias("item_id"), "sequence_id", F.col("offsets").alias("offset"))


def sequences(pieces: DataFrame, assignment: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, n_tokens, ids``.

    ``ids`` are little-endian unsigned 32-bit integers. A group holds one sequence,
    hence at most ``capacity`` pieces and ids.
    """
    joined = pieces.join(assignment, "item_id")
    packed = joined.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("n_tokens"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"]))
    return packed.select("sequence_id", "n_tokens", whole.alias("ids"))
