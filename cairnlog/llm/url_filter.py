"""URL rules looked up in sorted arrays of 64-bit digests.

Every entry is a host and a path written together, like ``example.net/en/``. Entries are
sharded by the leading bits of their xxHash; a shard is one file with its digests in
ascending order and the entries themselves behind them. Tasks map shards into memory,
find the digests of all host suffixes and path prefixes of a batch of URLs by binary
search, and compare the stored entry, so that a collision of digests never decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import attempt_name, new_folder, read_bytes, write_bytes

MAGIC = b"DIGESTS1"
ENTRIES_PER_SHARD = 1_000_000

_HOST_AND_PATH = re.compile(r"://([^/?#]*)([^?#]*)")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Lower-cased (A-Z) host and path; both empty without ``://``."""
    found = _HOST_AND_PATH.search(url) if url else None
    if found is None:
        return "", ""
    host = found[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return host, found[2]


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"))


def shard_bytes(entries: list[str], flags: list[int]) -> bytes:
    """A shard's file: digests, offsets and flags in digest order, then the entries."""
    raw = [entry.encode("utf-8", "surrogatepass") for entry in entries]
    keys = np.array([xxhash.xxh64_intdigest(entry) for entry in raw], "<u8")
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0, *(len(raw[i]) for i in order)]).astype("<u8")
    head = np.array([len(raw)], "<u8").tobytes()
    body = keys[order].tobytes() + ends.tobytes() + np.array(flags, "u1")[order].tobytes()
    return MAGIC + head + body + b"".join(raw[i] for i in order)


class Shard:
    """Look-ups in the bytes of a shard, which may be a memory map."""

    def __init__(self, data: np.ndarray) -> None:
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of digests")
        size = int(data[8:16].view("<u8")[0])
        self.keys = data[16 : 16 + 8 * size].view("<u8")
        self.ends = data[16 + 8 * size : 24 + 16 * size].view("<u8")
        self.flags = data[24 + 16 * size : 24 + 17 * size]
        self.entries = data[24 + 17 * size :]

    def find(self, keys: np.ndarray, entries: list[str]) -> np.ndarray:
        """Flags of the entries, -1 for those that are not stored."""
        out = np.full(len(entries), -1, "int64")
        place = np.searchsorted(self.keys, keys)
        inside = np.flatnonzero(place < len(self.keys))
        for i in inside[self.keys[place[inside]] == keys[inside]].tolist():
            wanted = entries[i].encode("utf-8", "surrogatepass")
            at = int(place[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:
                if bytes(self.entries[int(self.ends[at]) : int(self.ends[at + 1])]) == wanted:
                    out[i] = int(self.flags[at])
                    break
                at += 1
        return out


#: Bits of an entry's flag.
ALLOW, NAMED = 1, 2


def write_index(entries: DataFrame, folder: str | None = None) -> str:
    """Index ``entry string, verdict string, named boolean``; returns its folder.

    ``named`` entries are rules that results name, others are list members. An entry is
    a host, a slash and the rest of a path. Null entries and those without a slash are
    left out. Of repeated entries one stays: named before unnamed, allow before block.
    """
    spark = entries.sparkSession
    folder = folder or new_folder(spark, "url-index")
    flag = F.when(F.col("verdict") == "allow", ALLOW).otherwise(0) + F.when(
        F.coalesce("named", F.lit(False)), NAMED
    ).otherwise(0)
    rows = (
        entries.where(F.col("entry").contains("/"))
        .groupBy("entry")
        .agg(F.max(flag).cast("int").alias("flag"))
    )
    shards = 1
    count = rows.count()
    while shards * ENTRIES_PER_SHARD < count:
        shards *= 2
    bits = shards.bit_length() - 1

    @F.pandas_udf("int")
    def shard_of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(text) >> (64 - bits) if bits else 0 for text in texts], dtype="int32")

    def write(part: pd.DataFrame) -> pd.DataFrame:
        name = attempt_name("shard", int(part["shard"].iloc[0])) + ".digests"
        write_bytes(f"{folder}/{name}", shard_bytes(part["entry"].tolist(), part["flag"].tolist()))
        lengths = sorted({len(entry) - entry.index("/") for entry in part["entry"]})
        return pd.DataFrame(
            [{"shard": int(part["shard"].iloc[0]), "file": name, "bits": bits, "lengths": lengths}]
        )

    written = rows.withColumn("shard", shard_of("entry")).groupBy("shard").applyInPandas(
        write, "shard int, file string, bits int, lengths array<int>"
    )
    written.write.parquet(f"{folder}/shards")
    return folder


def judge_urls(
    pages: DataFrame, index: str, *, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """``<id>, host, path, rule, verdict`` for every row.

    An entry fits its host and all subdomains where the path starts with the entry's.
    The longest fitting rule wins, the longer host among equals. Without a rule a fitting
    list member blocks; else the URL is allowed. A null URL or one without ``://`` has an
    empty host and path. Repeated rows are judged alike; other columns are ignored.
    """
    spark = pages.sparkSession
    # One row per shard of a million entries.
    listed = spark.read.parquet(f"{index}/shards").collect()
    bits = listed[0]["bits"] if listed else 0
    files = {row["shard"]: row["file"] for row in listed}
    lengths = sorted({length for row in listed for length in row["lengths"]})
    kind = pages.schema[id_column].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards: dict[int, Shard] = {}
        for batch in batches:
            places = [host_and_path(url) for url in batch["url"]]
            owners, entries, sizes = [], [], []
            for owner, (host, path) in enumerate(places):
                suffix = host
                while suffix:
                    for length in lengths:
                        if length <= len(path):
                            owners.append(owner)
                            entries.append(suffix + path[:length])
                            sizes.append((len(suffix) + length, len(suffix)))
                    suffix = suffix.partition(".")[2]
            keys = np.array([digest(entry) for entry in entries], "<u8")
            which = (keys >> np.uint64(64 - bits)).astype("int64") if bits else np.zeros(len(keys), "int64")
            flags = np.full(len(entries), -1, "int64")
            for shard in np.unique(which).tolist():
                if shard not in files:
                    continue
                if shard not in shards:
                    shards[shard] = Shard(read_bytes(f"{index}/{files[shard]}"))
                own = np.flatnonzero(which == shard)
                flags[own] = shards[shard].find(keys[own], [entries[i] for i in own.tolist()])
            best: dict[int, tuple] = {}
            member: set[int] = set()
            for i in np.flatnonzero(flags >= 0).tolist():
                if not flags[i] & NAMED:
                    if not flags[i] & ALLOW:
                        member.add(owners[i])
                elif owners[i] not in best or best[owners[i]][0] < sizes[i]:
                    best[owners[i]] = (sizes[i], entries[i], "allow" if flags[i] & ALLOW else "block")
            rule = [best[i][1] if i in best else None for i in range(len(batch))]
            verdict = [
                best[i][2] if i in best else "block" if i in member else "allow"
                for i in range(len(batch))
            ]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "host": [host for host, _ in places],
                    "path": [path for _, path in places],
                    "rule": pd.Series(rule, dtype=object),
                    "verdict": verdict,
                }
            )

    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    judged = rows.mapInPandas(judge, f"id {kind}, host string, path string, rule string, verdict string")
    return judged.withColumnRenamed("id", id_column)
