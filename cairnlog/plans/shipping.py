"""What Python workers need: the library's own code, batches of a fair size, and tidiness.

Functions that run in tasks import this package there. A cluster whose executors do not
have it installed gets it as a zip file through Spark, once per application.
"""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from .files import new_folder, write_bytes

_SHIPPED: set[str] = set()


#: Rows of a batch that a worker gets. Spark's own 10,000 texts are held by the worker as
#: Arrow, as Python objects and once more as results.
BATCH_ROWS = 1_000


def ship_code(spark: SparkSession) -> None:
    """Make the package known to the executors, and batches smaller where nothing is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent).as_posix())
    address = f"{new_folder(spark, 'code')}/{package.name}.zip"
    write_bytes(address, packed.getvalue())
    context.addPyFile(address)
    _SHIPPED.add(context.applicationId)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives unused memory back to the system when it is done.

    Spark keeps workers for later tasks; what allocators hold back for them adds up over
    a job of many stages.
    """

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc
