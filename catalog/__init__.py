"""Queries over the given tables, each with the SQL that checks it.

Every module fills ``CATALOG`` through ``register``: a name that starts with the
operator's id, a function from ``Tables`` to a DataFrame, and DuckDB SQL with the same
columns (none where SQL cannot say it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Tables


@dataclass(frozen=True)
class Entry:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def register(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in CATALOG:
        raise ValueError(f"{name} is registered twice")
    CATALOG[name] = Entry(run, sql)


def load() -> dict[str, Entry]:
    from . import (  # noqa: F401
        answers,
        counts,
        files,
        ingest,
        lines,
        results,
        runs,
        sessions,
        vectors,
    )

    return CATALOG


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: entry.run(Tables(spark, sf_dir))

    return {name: bind(entry) for name, entry in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in load().items() if entry.sql is not None}
