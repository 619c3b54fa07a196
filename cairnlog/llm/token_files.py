"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, each closed by an end id. Ids are cut
into blocks of ``BLOCK``. A block is stored as its minimum, a width in bits that fits a
given share of the values above the minimum, the low bits of all values in bit planes,
and an exception list with position and high bits of the values that need more. The
start of every block is indexed, so a reader can decode any range of blocks.

Layout, little-endian: magic, then u64 counts of ids, documents and blocks; document
lengths as u64; per block minimum u32, width u8, number of exceptions u16 and start of
its bit planes u64; positions u16 and high bits u32 of all exceptions in block order;
the bit planes, blocks of one width after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlog.plans.durable import materialise
from cairnlog.plans.prefix import running_totals

from .shipping import ship_code, tidied
from .storage import attempt_name, new_folder, read_bytes, write_bytes
from .tokenizer import encoder

MAGIC = b"PFORIDS1"
BLOCK = 1024
#: Share of a block's values that its width holds; the others are exceptions.
FITTING = 0.98
#: Ids after which a task begins the next file.
FILE_IDS = 8_000_000


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same values in 16 bits where they fit, which halves the work on bit planes."""
    return values.astype("<u2") if not len(values) or int(values.max()) < 1 << 16 else values


def encode_ids(ids: np.ndarray, lengths: np.ndarray, fitting: float = FITTING) -> bytes:
    """The bytes of a file with ``ids`` (unsigned 32 bit), cut into documents of ``lengths``."""
    blocks = -(-len(ids) // BLOCK)
    # The last block is filled up with its own last id; readers know the number of ids.
    padded = np.concatenate([ids, np.repeat(ids[-1:], blocks * BLOCK - len(ids))])
    rows = padded.reshape(blocks, BLOCK)
    minimum = rows.min(axis=1) if blocks else np.zeros(0, "<u4")
    rest = _narrow(rows.reshape(-1) - np.repeat(minimum, BLOCK)).reshape(blocks, BLOCK)
    place = min(BLOCK - 1, int(fitting * BLOCK))
    fits = np.partition(rest, place, axis=1)[:, place] if blocks else np.zeros(0, "<u2")
    width = np.array([int(value).bit_length() for value in fits], "u1")
    start = np.zeros(blocks, "<u8")
    outliers = np.zeros(blocks, "<u2")
    at = 0
    planes, exceptions = [], [(np.zeros(0, "i8"), np.zeros(0, "<u2"), np.zeros(0, "<u4"))]
    for bits in np.unique(width).tolist():
        own = np.flatnonzero(width == bits)
        values = rest[own]
        packed = np.empty((len(own), bits, BLOCK // 8), "u1")
        for bit in range(bits):
            one = (values >> values.dtype.type(bit)).astype("u1") & np.uint8(1)
            packed[:, bit] = np.packbits(one, axis=1)
        planes.append(packed.tobytes())
        start[own] = at + np.arange(len(own)) * (bits * BLOCK // 8)
        at += packed.size
        if bits < 8 * values.dtype.itemsize:
            high = values >> values.dtype.type(bits)
            row, column = np.nonzero(high)
            outliers[own] = np.bincount(row, minlength=len(own))
            exceptions.append((own[row], column.astype("<u2"), high[row, column].astype("<u4")))
    which, column, high = (np.concatenate(part) for part in zip(*exceptions))
    order = np.argsort(which, kind="stable")
    counts = np.array([len(ids), len(lengths), blocks], "<u8")
    head = (counts, np.asarray(lengths, "<u8"), minimum, width, outliers, start)
    patches = (column[order], high[order])
    return b"".join([MAGIC, *(x.tobytes() for x in head + patches), *planes])


class TokenFile:
    """A reader of the bytes of one file."""

    def __init__(self, data) -> None:
        self.data = np.frombuffer(data, "u1") if isinstance(data, bytes) else data
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        self.at = 8
        self.n_ids, documents, blocks = (int(x) for x in self._take("<u8", 3))
        self.lengths = self._take("<u8", documents)
        self.minimum = self._take("<u4", blocks)
        self.width = self._take("u1", blocks)
        outliers = self._take("<u2", blocks).astype("i8")
        self.start = self._take("<u8", blocks)
        self.patch = np.concatenate([[0], np.cumsum(outliers)])
        self.column = self._take("<u2", int(outliers.sum()))
        self.high = self._take("<u4", int(outliers.sum()))

    def _take(self, kind: str, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        self.at += size
        return np.frombuffer(bytes(self.data[self.at - size : self.at]), kind)

    def _blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` up to ``last``; blocks of one width lie together."""
        widths = self.width[first:last]
        kind = "<u2" if int(widths.max()) <= 16 else "<u4"
        values = np.zeros((last - first, BLOCK), kind)
        for bits in np.unique(widths).tolist():
            own = np.flatnonzero(widths == bits)
            begin = self.at + int(self.start[first + own[0]])
            packed = self.data[begin : begin + len(own) * bits * BLOCK // 8]
            planes = packed.reshape(len(own), bits, BLOCK // 8)
            part = np.zeros((len(own), BLOCK), kind)
            for bit in range(bits):
                part |= np.unpackbits(planes[:, bit], axis=1).astype(kind) << part.dtype.type(bit)
            values[own] = part
        out = values.astype("<u4")
        patches = slice(self.patch[first], self.patch[last])
        row = np.repeat(np.arange(last - first), np.diff(self.patch[first : last + 1]))
        out[row, self.column[patches]] += self.high[patches] << widths[row].astype("<u4")
        return (out + self.minimum[first:last, None]).reshape(-1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` up to ``end``; only their blocks are decoded."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first = begin // BLOCK
        return self._blocks(first, -(-end // BLOCK))[begin - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of one document after the other, a window of blocks at a time."""
        ends = np.cumsum(self.lengths).astype("int64")
        begins = ends - self.lengths.astype("int64")
        first = 0
        while first < len(ends):
            last = first
            while last + 1 < len(ends) and ends[last + 1] - begins[first] <= 1024 * BLOCK:
                last += 1
            window = self.ids(int(begins[first]), int(ends[last]))
            for number in range(first, last + 1):
                yield window[begins[number] - begins[first] : ends[number] - begins[first]]
            first = last + 1


_MANIFEST = (
    "file string, partition int, number int, first_id long, n_docs long, n_ids long, doc_ids binary"
)


def write_token_files(
    documents: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 0,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the table of files.

    ``file, partition, number, first_id, n_docs, n_ids, doc_ids`` (the documents of the
    file, 64-bit little-endian), one row per file, stored as a table in ``folder``. Only
    listed files count. A null text is an empty one: its document has only the end id.
    A null id comes first and is kept as null. Repeated ids stay next to each other,
    in the order of digests of their texts. An empty input gives no file. Ids must be integers.
    """
    ship_code(documents.sparkSession)
    spark = documents.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    rows = documents.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")
    )
    # A digest in the ranges splits rows that share an id, or have none.
    keyed = rows.withColumn("digest", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest", "text").drop("digest")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all = encoder(tokenizer_path).encode_all
        end = np.array([end_id], "<u4").tobytes()
        parts: list[bytes] = []
        owners: list[int] = []
        number = waiting = 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(part) // 4 for part in parts], "<u8")
            name = attempt_name("ids", number) + ".pfor"
            write_bytes(f"{folder}/{name}", encode_ids(np.frombuffer(b"".join(parts), "<u4"), lengths))
            row = {
                "file": name, "partition": partition, "number": number, "first_id": owners[0],
                "n_docs": len(parts), "n_ids": int(lengths.sum()),
                "doc_ids": np.array(owners, "<i8").tobytes(),
            }
            return pd.DataFrame([row])

        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        for batch in batches:
            for owner, ids in zip(batch["id"], encode_all(batch["text"])):
                part = ids + end
                parts.append(part)
                owners.append(NULL_ID if pd.isna(owner) else int(owner))
                waiting += len(part) // 4
                if waiting >= file_ids:
                    yield close()
                    parts, owners, waiting, number = [], [], 0, number + 1
        if parts:
            yield close()

    ordered.mapInPandas(tidied(write), _MANIFEST).write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


#: Stands for a null document id inside files; no document may have it.
NULL_ID = -(2**63)


def read_token_files(spark: SparkSession, folder: str, *, id_column: str = "doc_id") -> DataFrame:
    """Documents of a folder of token files: id, ``start``, ``n_tokens`` and ``ids``.

    ``start`` counts the ids of all documents before this one, ``ids`` are little-endian
    unsigned 32-bit integers. Files are decoded by as many tasks as there are files.
    """
    files = spark.read.parquet(f"{folder}/files")
    # Names and sizes of files only are summed up, not what documents they hold.
    sizes = files.select("file", "partition", "number", "n_ids")
    bases = running_totals(sizes, ["partition", "number"], {"base": "n_ids"}).select("file", "base")
    dealt = files.join(materialise(bases, "file-offsets"), "file").repartition(max(1, files.count()), "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                file = TokenFile(read_bytes(f"{folder}/{row.file}"))
                owners = np.frombuffer(row.doc_ids, "<i8")
                start, out = int(row.base), []
                size = 0
                for owner, ids in zip(owners, file.documents()):
                    out.append((owner, start, len(ids), ids.tobytes()))
                    start += len(ids)
                    size += len(ids)
                    if size >= 1_000_000:
                        yield _rows(out)
                        out, size = [], 0
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids"])
        frame["id"] = frame["id"].astype("Int64").mask(frame["id"] == NULL_ID)
        return frame

    decoded = dealt.select("file", "base", "doc_ids").mapInPandas(
        read, "id long, start long, n_tokens long, ids binary"
    )
    return decoded.withColumnRenamed("id", id_column)
