"""Binary files in the folder that all executors share.

Spark's writers commit tables; the files here are formats of their own. A task writes
each file under a name that holds its attempt, and reports it in a table that Spark
commits: files of lost or repeated attempts are never read, as no table lists them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import materialise, shared_dir

#: Files, and their bytes, that one task reads.
TASK_FILES = 10_000
TASK_BYTES = 64 * 1024 * 1024


def new_folder(spark: SparkSession, label: str) -> str:
    """The address of a folder that does not exist yet, below the shared one."""
    return f"{shared_dir(spark)}/cairnlog/{label}-{uuid.uuid4().hex}"


def _filesystem(address: str):
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def attempt_name(prefix: str, number: int) -> str:
    """A file name no other attempt of this or another task uses."""
    context = TaskContext.get()
    return f"{prefix}-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}"


def write_bytes(address: str, data: bytes) -> None:
    system, path = _filesystem(address)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def read_bytes(address: str):
    """A buffer of the file's bytes: mapped into memory where the file is a local path."""
    import numpy as np
    from pyarrow import fs

    system, path = _filesystem(address)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r")
    with system.open_input_stream(path) as stream:
        return np.frombuffer(stream.read(), dtype=np.uint8)


def opens(address: str) -> bool:
    """Whether tasks can open files there by themselves, not only Spark's readers."""
    try:
        _filesystem(address)
    except (pa.ArrowException, OSError):
        return False
    return True


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and bytes of what is directly in a folder."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                yield entry.name, entry.is_dir(), entry.stat().st_size
        return
    for info in system.get_file_info(fs.FileSelector(path)):
        yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def listed(spark: SparkSession, folders: Sequence[str], pattern: str) -> DataFrame:
    """``folder, name, size, inner`` of the files directly in folders, stored; tasks list them.

    Names are those that Spark's readers see, and fit ``pattern``; empty files are none. ``inner`` rows are
    folders by which those readers would tell partitions.
    """

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                rows = []
                for name, inner, size in _entries(folder):
                    hidden = name.startswith(".") or (name.startswith("_") and "=" not in name)
                    fits = "=" in name if inner else size and fnmatchcase(name, pattern)
                    if fits and not hidden:
                        rows.append((folder, name, size, inner))
                    if len(rows) >= TASK_FILES:
                        yield _listing(rows)
                        rows = []
                yield _listing(rows)

    tasks = max(1, min(len(folders), 4 * spark.sparkContext.defaultParallelism))
    given = spark.createDataFrame([(folder,) for folder in folders], "folder string").repartition(tasks)
    return materialise(given.mapInArrow(listing, "folder string, name string, size long, inner boolean"), "file-names")


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, kinds)], names=["folder", "name", "size", "inner"]
    )


def dealt(files: DataFrame) -> DataFrame:
    """``files`` over so many partitions that none has very many of them, or of their bytes."""
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total["n"] // TASK_FILES), -(-(total["size"] or 0) // TASK_BYTES), min(total["n"], cores), 1)
    return files.repartition(tasks, "folder", "name")


def metadata_name(name: str) -> str:
    """The name of a file as ``_metadata.file_name`` tells it: a part of a URI, letters of any script as they are."""
    return "".join(c if c > "\x7f" and not c.isspace() else quote(c, safe="-_.!~*'(),;:$&+=@") for c in name)


def read_whole(address: str) -> bytes:
    system, path = _filesystem(address)
    with system.open_input_stream(path, compression=None) as stream:
        return stream.read()
