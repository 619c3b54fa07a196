"""Repeated runs of lines removed from all but their first place, by content-defined chunks.

Lines are hashed, and a rolling hash over the hashes of the last ``ROLLED`` lines decides
after which of them a chunk ends, once it holds ``LEAST_LINES`` lines with text. So the
boundaries follow the lines themselves: a text that was moved, or continued in another way,
falls into the same chunks again a few lines after the change. Chunks whose digests occur
more than once are compared byte by byte with the first occurrence. Equal ones are removed,
and with them the lines next to them, within the neighbouring chunks, as long as they are
equal to the lines next to the first occurrence: these belong to the repeated run, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh_name, squeezed, unsqueezed
from .shingles import mix
from .shipping import ship_code, tidied

#: Lines under the rolling hash.
ROLLED = 2
#: One in so many lines ends a chunk that is long enough.
ODDS = 2
#: Lines with text that a chunk has at least; the last one of a document may have fewer.
LEAST_LINES = 2

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def rolling_hashes(hashes: np.ndarray) -> np.ndarray:
    """For every line the hash of the last ``ROLLED`` lines; 0 where there are fewer."""
    out = np.zeros(len(hashes), "u8")
    count = len(hashes) - ROLLED + 1
    if count > 0:
        rolled = np.zeros(count, "u8")
        for place in range(ROLLED):
            rolled = rolled * _FACTOR + hashes[place : place + count]
        out[ROLLED - 1 :] = mix(rolled)
    return out


def chunk_bounds(lines: list[bytes]) -> list[tuple[int, int, bool]]:
    """First line, end line and whether it has ``LEAST_LINES`` lines with text, of every chunk."""
    hashes = np.array([xxhash.xxh64_intdigest(line) for line in lines], "u8")
    ends = (rolling_hashes(hashes) % np.uint64(ODDS) == 0).tolist()
    bounds, begin, filled = [], 0, 0
    for place, line in enumerate(lines):
        filled += not (line.isspace() or not line)
        if filled >= LEAST_LINES and ends[place]:
            bounds.append((begin, place + 1, True))
            begin, filled = place + 1, 0
    if begin < len(lines):
        bounds.append((begin, len(lines), filled >= LEAST_LINES))
    return bounds


def chunks(text: str | bytes | None) -> Iterator[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of every chunk that is long enough to go."""
    if not text:
        return
    lines = _lines(text)
    for begin, end, long_enough in chunk_bounds(lines):
        if long_enough:
            yield begin, end - begin, b"\n".join(lines[begin:end])


def _lines(text: str | bytes) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.split(b"\n")


def _digests(chunk: bytes) -> tuple[int, int]:
    number = xxhash.xxh3_128_intdigest(chunk)
    return int(np.uint64(number >> 64).view("i8")), int(np.uint64(number & (2**64 - 1)).view("i8"))


def shared_neighbours(
    before: bytes | None, after: bytes | None, first_before: bytes | None, first_after: bytes | None
) -> tuple[int, int]:
    """Lines next to a chunk, before and after, that are those next to its first occurrence."""

    def same(a: list[bytes], b: list[bytes]) -> int:
        count = 0
        for x, y in zip(a, b):
            if x != y:
                break
            count += 1
        return count

    def cut(part: bytes | None) -> list[bytes]:
        return [] if part is None else part.split(b"\n")

    return same(cut(before)[::-1], cut(first_before)[::-1]), same(cut(after), cut(first_after))


_PLACE = "id long, text_hash long, first_line int, n_lines int"


def repeated_chunks(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, text_hash, first_line, n_lines, n_before, n_after`` of every chunk that occurs earlier.

    "Earlier" is a smaller id, or the same id and a smaller line; bytes are compared.
    ``n_before`` and ``n_after`` lines around the chunk are repeated with it. ``text_hash``
    tells apart rows that share an id.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    ).where(F.col("id").isNotNull())
    rows = rows.withColumn("text_hash", F.xxhash64("text"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (doc, hash_, begin, size, *_digests(chunk))
                for doc, hash_, text in zip(batch["id"].tolist(), batch["text_hash"].tolist(), batch["text"])
                for begin, size, chunk in chunks(text)
            ]
            yield pd.DataFrame(out, columns=["id", "text_hash", "first_line", "n_lines", "hi", "lo"])

    found = rows.select("id", "text_hash", "text").mapInPandas(tidied(digest), f"{_PLACE}, hi long, lo long")
    place = F.struct("id", "first_line")
    first = (
        found.groupBy("hi", "lo")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") < F.col("last"))
    )
    repeated = found.join(first.select("hi", "lo"), ["hi", "lo"])
    wanted = repeated.groupBy("id", "text_hash").agg(F.collect_set("first_line").alias("wanted"))
    packed = rows.select("id", "text_hash", squeezed("text").alias("text"))
    # Rows with the same id and text are told apart by nothing, and need not be.
    with_text = packed.join(wanted, ["id", "text_hash"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, hash_, text, firsts in zip(
                batch["id"].tolist(), batch["text_hash"].tolist(), batch["text"], batch["wanted"]
            ):
                lines, own = _lines(unsqueezed(text)), set(firsts.tolist())
                bounds = chunk_bounds(lines)
                for number, (begin, end, _) in enumerate(bounds):
                    if begin not in own:
                        continue
                    chunk = b"\n".join(lines[begin:end])
                    # Neighbours that are repeated themselves need not be looked at.
                    around = []
                    for other in (number - 1, number + 1):
                        known = 0 <= other < len(bounds) and bounds[other][0] not in own
                        around.append(b"\n".join(lines[slice(*bounds[other][:2])]) if known else None)
                    out.append((doc, hash_, begin, end - begin, *_digests(chunk), chunk, *around))
            yield pd.DataFrame(
                out,
                columns=["id", "text_hash", "first_line", "n_lines", "hi", "lo", "chunk", "before", "after"],
            )

    texts = with_text.mapInPandas(
        tidied(cut), f"{_PLACE}, hi long, lo long, chunk binary, before binary, after binary"
    )
    # Equal bytes under one digest: the smallest place of each is the one that stays.
    stays = texts.groupBy("hi", "lo", "chunk").agg(
        F.min(F.struct("id", "first_line", "before", "after")).alias("stays")
    )
    stays = stays.select("hi", "lo", F.col("chunk").alias("bytes"), "stays")
    behind = texts.join(stays, ["hi", "lo"]).where(
        (F.col("chunk") == F.col("bytes")) & (place > F.struct("stays.id", "stays.first_line"))
    )
    sides = behind.select(
        "id", "text_hash", "first_line", "n_lines", "before", "after",
        F.col("stays.before").alias("first_before"), F.col("stays.after").alias("first_after"),
    )

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = zip(batch["before"], batch["after"], batch["first_before"], batch["first_after"])
            shared = np.array([shared_neighbours(*side) for side in sides], "i4").reshape(-1, 2)
            out = batch[["id", "text_hash", "first_line", "n_lines"]].copy()
            out["n_before"], out["n_after"] = shared[:, 0], shared[:, 1]
            yield out

    return sides.mapInPandas(tidied(grow), f"{_PLACE}, n_before int, n_after int")


def without_lines(text: str | None, ranges: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """The text without ranges of lines, its lines before, and how many were removed."""
    if text is None:
        return None, 0, 0
    lines = _lines(text)
    if not ranges:
        return text, len(lines), 0
    stay = np.ones(len(lines), bool)
    for begin, end in ranges:
        stay[begin:end] = False
    kept = b"\n".join(line for line, stays in zip(lines, stay.tolist()) if stays)
    return kept.decode("utf-8", "surrogatepass"), len(lines), int((~stay).sum())


def remove_repeated_chunks(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    result: str = "deduped",
) -> tuple[DataFrame, str]:
    """All rows and columns, and the name of a struct column ``text, n_lines, n_removed``.

    The struct is named ``result``, with underscores in front while a column of that
    name exists. Of chunks with equal bytes the first one stays, by id, then line; the first
    place of a line always stays. A chunk has two lines with text or more, so a line that
    is repeated alone stays, also between blank lines. Null texts stay null and have no
    lines; an empty text has one empty line; texts of one line stay. Rows with a null id are
    not compared. Rows that share an id count as one document: equal chunks at the same
    line of both stay; what is removed from one is not from another with other text.
    """
    ship_code(documents.sparkSession)
    name = fresh_name(documents.columns, result)
    key = fresh_name(documents.columns, "chunk_owner")
    hash_ = fresh_name(documents.columns, "chunk_text")
    gone = fresh_name(documents.columns, "chunks_gone")
    found = repeated_chunks(documents, id_column=id_column, text_column=text_column)
    first = F.col("first_line") - F.col("n_before")
    end = F.col("first_line") + F.col("n_lines") + F.col("n_after")
    lists = found.groupBy(F.col("id").alias(key), F.col("text_hash").alias(hash_)).agg(
        F.collect_set(F.struct(first.alias("begin"), end.alias("end"))).alias(gone)
    )

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def clean(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = [
            without_lines(text, [] if b is None else list(zip(b.tolist(), e.tolist())))
            for text, b, e in zip(texts, begins, ends)
        ]
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    def part(field: str) -> Column:
        return F.transform(gone, lambda g: g[field])

    same = (F.col(id_column).cast("long") == F.col(key)) & (F.xxhash64(text_column) == F.col(hash_))
    joined = documents.join(lists, same, "left")
    cleaned = joined.withColumn(
        name, clean.asNondeterministic()(F.col(text_column), part("begin"), part("end"))
    )
    return cleaned.drop(key, hash_, gone), name
