"""Vectors compressed to one byte a part, entries found by equal-average search.

A vector is cut into parts, and every part position has a codebook. Rounds of assignment
and averaging run over stored vectors: a task sums up its parts by entry, Spark adds the
sums, and the codebooks, whose size is set by parameters, go out with the next round.

Entries are sorted by the sum of their components. By Cauchy and Schwarz the squared gap
between the sums of a part and of an entry is at most the part's dimension times their
squared distance. So the search starts among the entries whose sums are next to the
part's and expands outward on both sides, until the squared gap over the dimension
strictly exceeds the best distance; entries beyond could not even tie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise

from .shipping import ship_code
from .vector_rows import integer_vectors, matrix, usual_length

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Parts with neighbouring sums that expand together, and entries taken in at a time.
GROUP = 256
STEP = 16


class Codebook:
    """Entries of one part position, in the order of their sums.

    Distances are whole numbers in floats; ``fits`` tells whether all of them are exact.
    """

    def __init__(self, entries: np.ndarray) -> None:
        sums = entries.sum(axis=1)
        self.index = np.argsort(sums, kind="stable")
        self.sums = sums[self.index]
        self.entries = entries[self.index].astype("f8")
        self.squares = (self.entries**2).sum(axis=1)
        self.searched = 0

    @staticmethod
    def fits(greatest: int, width: int) -> bool:
        return 4 * width * greatest**2 < 2**52

    def _keys(self, parts: np.ndarray, squares: np.ndarray, low: int, high: int) -> np.ndarray:
        """Distance and index in one number, the least of entries ``low`` up to ``high``."""
        self.searched += len(parts) * (high - low)
        distance = squares[:, None] + self.squares[low:high] - 2 * parts @ self.entries[low:high].T
        return (distance.astype("i8") * len(self.index) + self.index[low:high]).min(axis=1)

    def _nearest(self, parts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Keys of a group of parts in the order of their sums."""
        values = parts.astype("f8")
        squares = (values**2).sum(axis=1)
        count, width = len(self.index), parts.shape[1]
        low = int(np.searchsorted(self.sums, sums[0], "left"))
        high = int(np.searchsorted(self.sums, sums[-1], "right"))
        low, high = max(0, min(low, count - 1) - STEP // 2), min(count, high + STEP // 2)
        best = self._keys(values, squares, low, high)
        while low or high < count:
            reach = width * (best // count)
            if low:
                near = np.flatnonzero((sums - self.sums[low - 1]) ** 2 <= reach)
                begin = max(0, low - STEP) if len(near) else 0
                if len(near):
                    found = self._keys(values[near], squares[near], begin, low)
                    best[near] = np.minimum(best[near], found)
                low = begin
            reach = width * (best // count)
            if high < count:
                near = np.flatnonzero((self.sums[high] - sums) ** 2 <= reach)
                end = min(count, high + STEP) if len(near) else count
                if len(near):
                    found = self._keys(values[near], squares[near], high, end)
                    best[near] = np.minimum(best[near], found)
                high = end
        return best

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every part, the lower one of two, and the squared distance."""
        sums = parts.sum(axis=1)
        order = np.argsort(sums, kind="stable")
        keys = np.empty(len(parts), "i8")
        for at in range(0, len(parts), GROUP):
            group = order[at : at + GROUP]
            keys[group] = self._nearest(parts[group], sums[group])
        return keys % len(self.index), keys // len(self.index)


def part_bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts as equal as can be; a part has one component at least."""
    parts = min(parts, width)
    return [(width * i // parts, width * (i + 1) // parts) for i in range(parts)]


def _partial_sums(
    vectors: DataFrame, codebooks: list[np.ndarray], bounds: list[tuple[int, int]]
) -> DataFrame:
    """``part, entry, place, total, n`` of every task's parts by their nearest entry."""
    width = bounds[-1][1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries) for entries in codebooks]
        totals = [np.zeros_like(entries) for entries in codebooks]
        counts = [np.zeros(len(entries), "i8") for entries in codebooks]
        for batch in batches:
            rows = matrix(batch.column("q"), width)
            for (begin, end), book, total, count in zip(bounds, books, totals, counts):
                found, _ = book.nearest(rows[:, begin:end])
                np.add.at(total, found, rows[:, begin:end])
                count += np.bincount(found, minlength=len(count))
        for part, (total, count) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(count)
            places = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * places, part, "i4")),
                    pa.array(np.repeat(used, places).astype("i4")),
                    pa.array(np.tile(np.arange(places, dtype="i4"), len(used))),
                    pa.array(total[used].reshape(-1)),
                    pa.array(np.repeat(count[used], places)),
                ],
                names=["part", "entry", "place", "total", "n"],
            )

    return vectors.select("q").mapInArrow(add_up, "part int, entry int, place int, total long, n long")


def train_codebooks(
    vectors: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> list[np.ndarray]:
    """The entries of every part position after ``rounds`` of assignment and averaging.

    ``vectors`` has ``id`` and ``q`` of ``width`` whole numbers. Codebooks start as the
    parts of the ``entries`` smallest ids (of equal ids the smaller vector), in this order;
    with fewer vectors they have fewer entries. Averages are rounded down; entries that no
    part is nearest to stay as they are. ``entries`` times ``width`` numbers go through the driver.
    """
    bounds = part_bounds(width, parts)
    first = vectors.orderBy(F.asc_nulls_last("id"), "q").select("q").limit(entries).collect()
    start = np.array([row["q"] for row in first], "i8").reshape(-1, width)
    codebooks = [start[:, begin:end].copy() for begin, end in bounds]
    for _ in range(rounds if len(start) else 0):
        sums = _partial_sums(vectors, codebooks, bounds).groupBy("part", "entry", "place")
        for row in sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            codebooks[row["part"]][row["entry"], row["place"]] = row["total"] // row["n"]
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    numbers = ",".join(str(x) for entries in codebooks for x in entries.reshape(-1).tolist())
    return hashlib.sha256(numbers.encode()).hexdigest()


def encode_vectors(
    vectors: DataFrame, codebooks: list[np.ndarray], bounds: list[tuple[int, int]]
) -> DataFrame:
    """``id, label, code, error``: entry numbers in hex, two digits a part, and squared distance."""
    width = bounds[-1][1]
    label = vectors.schema["label"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(entries) for entries in codebooks]
        for batch in batches:
            rows = matrix(batch.column("q"), width)
            found = [book.nearest(rows[:, b:e]) for (b, e), book in zip(bounds, books)]
            codes = np.stack([index for index, _ in found], axis=1).astype("u1")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([code.tobytes().hex() for code in codes], pa.string()),
                    pa.array(sum(distance for _, distance in found)),
                ],
                names=["id", "label", "code", "error"],
            )

    kind = f"id long, label {label.simpleString()}, code string, error long"
    return vectors.select("id", "label", "q").mapInArrow(encode, kind)


def compress_vectors(
    table: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks they refer to.

    ``<id>, code, error, label_error``, one row per vector; ``label_error`` adds up
    ``error`` over rows with the same label, nulls together. Vectors that are null, empty or
    hold null or other than finite components are left out, and so are those of another
    length than most have (the greater of two such lengths). Repeated ids stay rows of
    their own. A length that the parts do not divide is cut as evenly as can be. Without
    a vector there is no row and no entry. Components so large that distances would not
    be exact are refused. Other columns are ignored. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    ship_code(table.sparkSession)
    whole = materialise(
        integer_vectors(table, scale, id_column, vector_column, label_column), "integer-vectors"
    )
    width, _ = usual_length(whole)
    vectors = whole.where(F.size("q") == width)
    greatest = vectors.agg(F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))).first()[0] or 0
    bounds = part_bounds(width, parts) if width else [(0, 0)]
    if not Codebook.fits(greatest, max(end - begin for begin, end in bounds)):
        raise ValueError("components are too large for exact distances")
    codebooks = train_codebooks(vectors, width, parts=parts, entries=entries, rounds=rounds) if width else []
    coded = materialise(encode_vectors(vectors, codebooks, bounds), "vector-codes")
    sums = materialise(
        coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors"
    )
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error"), codebooks
