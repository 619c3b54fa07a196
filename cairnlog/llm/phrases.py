"""Repeated passages located by automata and removed from all but the first document.

A window is ``WINDOW`` consecutive words. Documents are dealt to shards of bounded size,
and three passes over the shards find every window that starts in an earlier document:

1. Every window has a seed, its 5-word run with the smallest hash, so equal windows have
   equal seeds. A shard asks once for each of its seeds; those that several documents
   hold come back.
2. Windows with such a seed are confirmed by 96-bit digests. A shard asks once for each
   distinct window, with the smallest id that holds it. What comes back is one place in
   the shard for each window that another document holds, and whether that one is earlier
   than any of the shard's.
3. The passages at these places are compiled into the shard's Aho-Corasick automaton, with
   words as letters: a window contains one of the ``ANCHOR``-word pieces its passage is
   cut into. All documents of the shard are streamed through it; around every hit words
   are compared, and only this says where, how often and in which documents a passage
   occurs.

A passage that a third of all documents share is so one request and one answer per shard,
however often the shard holds it. Hash ranges are cut to a size that depends on the
amount of text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise

from .shingles import run_hashes
from .shipping import ship_code, tidied

WINDOW = 13
SEED = 5
#: Words of a pattern: every window of a passage holds one of its pieces at a multiple of it.
ANCHOR = (WINDOW + 1) // 2
#: Entries that one hash range is cut to hold.
RANGE_ENTRIES = 250_000
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 3_000_000
#: Letters that words are spelled with. Nodes of the automaton look through their children
#: one by one, so a word is several letters rather than one of very many.
LETTERS = 512


def window_seeds(hashes: np.ndarray) -> np.ndarray:
    """For every window the smallest hash of its 5-word runs."""
    least = run_hashes(hashes, SEED)
    runs, span = WINDOW - SEED + 1, 1
    while 2 * span <= runs:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = runs - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _numbered(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and for every word its number among them."""
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    return distinct, np.fromiter(map(number.__getitem__, words), "u4", len(words))


def _word_hashes(distinct: list[bytes], seed: int = 0) -> np.ndarray:
    """Hashes of words; those of different seeds do not depend on each other."""
    return np.fromiter((xxhash.xxh64_intdigest(word, seed) for word in distinct), "u8", len(distinct))


def _dealt(documents: DataFrame) -> DataFrame:
    """One row per shard, stored: ``shard, n_bytes, ids, named, sizes, texts``.

    ``texts`` are the shard's texts one after the other, compressed; ``sizes`` are theirs in
    bytes, ``ids`` 64-bit integers, ``named`` tells which are not null. Null texts are empty.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=3).compress
        first = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        texts: list[bytes] = []
        number = size = 0

        def close() -> pd.DataFrame:
            row = {
                "shard": first + number, "n_bytes": size,
                "ids": np.array([id_ or 0 for id_ in ids], "<i8").tobytes(),
                "named": np.array([id_ is not None for id_ in ids], "?").tobytes(),
                "sizes": [len(text) for text in texts], "texts": pack(b"".join(texts)),
            }
            return pd.DataFrame([row])

        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"]):
                raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > SHARD_BYTES:
                    yield close()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(None if pd.isna(id_) else int(id_))
                texts.append(raw)
                size += len(raw)
        if texts:
            yield close()

    kind = "shard long, n_bytes long, ids binary, named binary, sizes array<int>, texts binary"
    return materialise(documents.mapInPandas(tidied(deal), kind), "phrase-shards")


_SHARD = ("shard", "n_bytes", "ids", "named", "sizes", "texts")


def _documents(row) -> list[tuple[int | None, list[bytes]]]:
    """Id and words of every document of a shard."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(row.texts) if row.n_bytes else b""
    sizes = np.asarray(row.sizes, "i8")
    ids, named = np.frombuffer(row.ids, "<i8").tolist(), np.frombuffer(row.named, "?").tolist()
    return [
        (id_ if known else None, raw[end - size : end].split())
        for id_, known, size, end in zip(ids, named, sizes.tolist(), np.cumsum(sizes).tolist())
    ]


def _starts(keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Which entries of sorted arrays begin a group of equal ones."""
    first = np.ones(len(keys), bool)
    if len(keys):
        first[1:] = keys[1:] != keys[:-1]
        for other in more:
            first[1:] |= other[1:] != other[:-1]
    return first


def _by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The part of sorted 64-bit keys that falls into each hash range."""
    which = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype("i8")
    cuts = np.searchsorted(which, np.arange(ranges + 1))
    return [(n, slice(cuts[n], cuts[n + 1])) for n in np.flatnonzero(np.diff(cuts)).tolist()]


def _by_row(shards: pd.Series, asked: np.ndarray) -> list[tuple[int, slice]]:
    """Shards with the entries (in the order of rows) that their row of a request has."""
    rows, first = np.unique(asked, return_index=True)
    ends = np.append(first[1:], len(asked))
    return [(shards.iloc[row], slice(a, b)) for row, a, b in zip(rows.tolist(), first.tolist(), ends.tolist())]


class _Windows:
    """The windows of all documents of a shard that have an id, in one row of words.

    ``place`` says where in that row each window begins, ``number`` in which document, and
    ``seed`` is its seed. ``seeds`` are the distinct ones, ``group`` the seed of each window
    among them, and ``several`` tells which seeds more than one document holds.
    """

    def __init__(self, documents: list[tuple[int | None, list[bytes]]]) -> None:
        named = [(n, words) for n, (id_, words) in enumerate(documents) if id_ is not None and len(words) >= WINDOW]
        sizes = np.array([len(words) for _, words in named], "i8")
        self.distinct, self.words = _numbered([word for _, words in named for word in words])
        self.hashes = _word_hashes(self.distinct)[self.words]
        self.begins = np.zeros(len(documents), "i8")
        self.begins[[n for n, _ in named]] = np.cumsum(sizes) - sizes
        number = np.repeat(np.array([n for n, _ in named], "i8"), sizes)
        # A window must end in the document it begins in.
        inside = number[: len(number) - WINDOW + 1] == number[WINDOW - 1 :] if len(number) else np.zeros(0, bool)
        self.place = np.flatnonzero(inside)
        self.number = number[self.place]
        seed = window_seeds(self.hashes)[self.place] if len(self.place) else np.zeros(0, "u8")
        order = np.argsort(seed, kind="stable")
        first = _starts(seed[order])
        heads = np.flatnonzero(first)
        self.seeds = seed[order][heads]
        self.group = np.empty(len(seed), "i8")
        self.group[order] = np.cumsum(first) - 1
        # In the order of a stable sort the last window of a seed is in its last document.
        ends = np.append(heads[1:], len(seed)) - 1
        self.several = self.number[order[heads]] != self.number[order[ends]] if len(seed) else np.zeros(0, bool)


def _joined(parts, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join([] if parts is None else list(parts)), kind)


def _repeated_seeds(shards: DataFrame, ranges: int) -> DataFrame:
    """``shard, seeds`` that a document of another shard holds, too, packed by hash range."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                seeds = _Windows(_documents(row)).seeds
                out = [(number, row.shard, seeds[part].tobytes()) for number, part in _by_range(seeds, ranges)]
                yield pd.DataFrame(out, columns=["range", "shard", "seeds"])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        seeds = _joined(part["seeds"], "<u8")
        asked = np.repeat(np.arange(len(part)), [len(raw) // 8 for raw in part["seeds"]])
        order = np.argsort(seeds, kind="stable")
        seeds, asked = seeds[order], asked[order]
        first = _starts(seeds)
        group = np.cumsum(first) - 1
        several = np.bincount(group)[group] > 1 if len(seeds) else first
        seeds, asked = seeds[several], asked[several]
        order = np.argsort(asked, kind="stable")
        out = [(shard, seeds[order[own]].tobytes()) for shard, own in _by_row(part["shard"], asked[order])]
        return pd.DataFrame(out, columns=["shard", "seeds"])

    asked = shards.mapInPandas(tidied(ask), "range int, shard long, seeds binary")
    return asked.groupBy("range").applyInPandas(answer, "shard long, seeds binary")


def shard_windows(
    documents: list[tuple[int | None, list[bytes]]], repeated: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Distinct windows with a repeated seed, in the order of their digests.

    ``hi, lo``, the smallest id that holds the window, whether several ids of the shard do,
    and the number and place of a document of the smallest id. A seed is repeated if it is
    in ``repeated`` or several documents of the shard hold it.
    """
    windows = _Windows(documents)
    wanted = (windows.several | np.isin(windows.seeds, repeated))[windows.group]
    place, numbers = windows.place[wanted], windows.number[wanted]
    covered = np.zeros(len(windows.words) + 1, "i4")
    np.add.at(covered, place, 1)
    np.add.at(covered, place + WINDOW, -1)
    # Only words of such windows need a second hash.
    used = np.flatnonzero(np.cumsum(covered[:-1]))
    known = np.unique(windows.words[used])
    second = np.zeros(len(windows.distinct), "u8")
    second[known] = _word_hashes([windows.distinct[n] for n in known.tolist()], 1)
    others = second[windows.words]
    hi = run_hashes(windows.hashes, WINDOW)[place] if len(place) else np.zeros(0, "u8")
    lo = (run_hashes(others, WINDOW)[place] if len(place) else hi).astype("u4")
    ids = np.array([0 if id_ is None else id_ for id_, _ in documents], "i8")[numbers]
    places = (place - windows.begins[numbers]).astype("u4")
    numbers = numbers.astype("u4")
    order = np.lexsort((places, numbers, ids, lo, hi))
    hi, lo, ids, numbers, places = (column[order] for column in (hi, lo, ids, numbers, places))
    heads = np.flatnonzero(_starts(hi, lo))
    greatest = np.maximum.reduceat(ids, heads) if len(heads) else ids
    return hi[heads], lo[heads], ids[heads], greatest > ids[heads], numbers[heads], places[heads]


_COLUMNS = ("hi", "lo", "ids", "several", "numbers", "places")
_KINDS = ("<u8", "<u4", "<i8", "u1", "<u4", "<u4")
_REQUESTS = "range int, shard long, " + ", ".join(f"{name} binary" for name in _COLUMNS)
_ANSWERS = "shard long, earlier binary, numbers binary, places binary"


def _confirmed(shards: DataFrame, seeds: DataFrame, ranges: int) -> DataFrame:
    """Per shard and hash range the places of its windows that several ids hold.

    ``earlier`` tells for each whether an id smaller than all of the shard's holds it.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                columns = shard_windows(_documents(row), _joined(row.seeds, "<u8"))
                out = []
                for number, part in _by_range(columns[0], ranges):
                    # In document order ids and places shrink to little in a shuffle.
                    order = np.lexsort((columns[5][part], columns[4][part]))
                    out.append(
                        (number, row.shard, *(c[part][order].astype(k).tobytes() for c, k in zip(columns, _KINDS)))
                    )
                yield pd.DataFrame(out, columns=["range", "shard", *_COLUMNS])

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        asked = np.repeat(np.arange(len(part)), [len(raw) // 8 for raw in part["hi"]])
        hi, lo, ids, several, numbers, places = (_joined(part[c], k) for c, k in zip(_COLUMNS, _KINDS))
        order = np.lexsort((ids, lo, hi))
        first = _starts(hi[order], lo[order])
        least = np.empty_like(ids)
        least[order] = ids[order][np.flatnonzero(first)[np.cumsum(first) - 1]] if len(ids) else ids
        earlier = least < ids
        known = earlier | (several > 0)
        asked, *columns = (column[known] for column in (asked, earlier, numbers, places))
        out = [
            (shard, *(column[own].tobytes() for column in columns))
            for shard, own in _by_row(part["shard"], asked)
        ]
        return pd.DataFrame(out, columns=["shard", "earlier", "numbers", "places"])

    known = seeds.groupBy("shard").agg(F.collect_list("seeds").alias("seeds"))
    asking = shards.join(known, "shard", "left").select(*_SHARD, "seeds")
    return asking.mapInPandas(tidied(ask), _REQUESTS).groupBy("range").applyInPandas(answer, _ANSWERS)


def _spelled(documents: list[list[bytes]]) -> tuple[list[str], int]:
    """All documents with words as letters, and the letters of a word.

    A word is one letter, or as many as it takes beyond ``LETTERS`` distinct words.
    """
    distinct, numbers = _numbered([word for words in documents for word in words])
    width = 1
    while LETTERS**width < len(distinct):
        width += 1
    codes = np.empty((len(numbers), width), "<u4")
    rest = numbers.astype("u8")
    for place in range(width):
        rest, codes[:, place] = np.divmod(rest, np.uint64(LETTERS))
    text = (codes + np.uint32(1)).tobytes().decode("utf-32-le")
    ends = np.cumsum([len(words) for words in documents]) * width
    return [text[end - len(words) * width : end] for words, end in zip(documents, ends.tolist())], width


def locate_passages(
    documents: list[tuple[int | None, list[bytes]]], numbers: np.ndarray, places: np.ndarray, earlier: np.ndarray
) -> list[np.ndarray]:
    """For every document, which words lie in a window that a smaller id holds.

    Windows are given by document number and place, each once; ``earlier`` ones are held by
    an id smaller than any of these documents', the others by several of them.
    """
    import ahocorasick

    removed = [np.zeros(len(words), bool) for _, words in documents]
    if not len(places):
        return removed
    texts, width = _spelled([words for _, words in documents])
    order = np.lexsort((places, numbers))
    numbers, places, earlier = numbers[order].astype("i8"), places[order].astype("i8"), earlier[order]
    window, anchor = WINDOW * width, ANCHOR * width
    # The smallest id that holds a window: none yet, or one before all of these.
    holders: dict[str, int | None] = {}
    # Pieces with all windows around them, where all of these are held by an earlier id.
    surroundings: set[str] = set()
    automaton = ahocorasick.Automaton()
    begins = np.flatnonzero(
        (np.diff(numbers, prepend=-1) != 0) | (np.diff(places, prepend=-2) != 1) | (np.diff(earlier, prepend=False) != 0)
    )
    ends = np.append(begins[1:], len(places))
    lead = anchor - width
    for number, first, count, known in zip(
        numbers[begins].tolist(), places[begins].tolist(), (ends - begins).tolist(), earlier[begins].tolist()
    ):
        text = texts[number][first * width : (first + count - 1) * width + window]
        windows = [text[at : at + window] for at in range(0, count * width, width)]
        holders.update(dict.fromkeys(windows, _BEFORE_ALL if known else None))
        for at in range(0, len(text) - anchor + 1, anchor):
            automaton.add_word(text[at : at + anchor], True)
            if known and at >= lead and at + window <= len(text):
                surroundings.add(text[at - lead : at + window])
    automaton.make_automaton()
    ids = [id_ for id_, _ in documents]
    for number in sorted((n for n, id_ in enumerate(ids) if id_ is not None), key=lambda n: ids[n]):
        text, id_ = texts[number], ids[number]
        gone: list[int] = []
        until: list[int] = []
        # A hit stands for all windows that begin up to ``ANCHOR`` - 1 words before it.
        for last, _ in automaton.iter(text):
            hit = last + 1 - anchor
            if hit % width:
                continue
            if text[max(0, hit - lead) : hit + window] in surroundings:
                gone.append(hit - lead)
                until.append(hit + window)
                continue
            for at in range(max(0, hit - lead), hit + 1, width):
                holder = holders.get(text[at : at + window], _UNKNOWN)
                if holder is None:
                    holders[text[at : at + window]] = id_
                elif holder is not _UNKNOWN and holder < id_:
                    gone.append(at)
                    until.append(at + window)
        if gone:
            edges = np.zeros(len(removed[number]) + 1, "i8")
            np.add.at(edges, np.array(gone) // width, 1)
            np.add.at(edges, np.array(until) // width, -1)
            removed[number] = np.cumsum(edges[:-1]) > 0
    return removed


#: Smaller than any id.
_BEFORE_ALL = -(2**63) - 1
_UNKNOWN = object()


def remove_repeated_passages(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``<id>, n_words, n_removed, n_passages, kept`` for every row.

    A word goes if it lies in a window whose words also start in a document with a
    smaller id; ``kept`` are the other words joined by single spaces. Null and empty
    texts have no words and an empty ``kept``; texts shorter than a window stay. Rows
    with a null id are not compared and stay whole. Rows that share an id take nothing
    from each other, but each takes its own words from rows with greater ids. Other
    columns are ignored. Ids must be integers. Any number of distinct words will do.
    """
    ship_code(documents.sparkSession)
    given = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    shards = _dealt(given)
    size = shards.agg(F.sum("n_bytes")).first()[0] or 0
    # About six bytes to a word and two seeds to nine words.
    ranges = int(size / 27 / RANGE_ENTRIES) + 1
    confirmed = _confirmed(shards, _repeated_seeds(shards, ranges), ranges)
    lists = confirmed.groupBy("shard").agg(
        F.collect_list(F.struct("earlier", "numbers", "places")).alias("found")
    )
    marked = shards.join(lists, "shard", "left").select(
        *_SHARD,
        *(F.transform("found", lambda x: x[name]).alias(name) for name in ("earlier", "numbers", "places")),
    )

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                own = _documents(row)
                gone = locate_passages(
                    own, _joined(row.numbers, "<u4"), _joined(row.places, "<u4"), _joined(row.earlier, "?")
                )
                kept = [
                    b" ".join([w for w, out in zip(words, mark.tolist()) if not out] if mark.any() else words)
                    for (_, words), mark in zip(own, gone)
                ]
                yield pd.DataFrame(
                    {
                        "id": pd.array([id_ for id_, _ in own], "Int64"),
                        "n_words": [len(words) for _, words in own],
                        "n_removed": [int(mark.sum()) for mark in gone],
                        "n_passages": [int((np.diff(mark.astype("i1"), prepend=0) == 1).sum()) for mark in gone],
                        "kept": [text.decode("utf-8", "surrogatepass") for text in kept],
                    }
                )

    located = marked.mapInPandas(
        tidied(locate), "id long, n_words long, n_removed long, n_passages long, kept string"
    )
    return located.withColumnRenamed("id", id_column)
