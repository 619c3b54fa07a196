"""Run catalog queries in Spark and DuckDB on the same tables and compare the rows.

    python -m catalog.compare SF_DIR [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import load
from .views import Tables

DUCKDB_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "FLOAT": "float", "TIMESTAMP": "timestamp_ntz",
}


def connect(sf_dir: str):
    import duckdb

    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return "~" if value is None else str(value)


def rows_of(names: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def check(frame: DataFrame, sql: str, base) -> str | None:
    """What differs between the two results, None when nothing does."""
    relation = base.sql(sql)
    spark_types = dict(frame.dtypes)
    duck_types = {n: DUCKDB_TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    if sorted(spark_types) != sorted(duck_types):
        return f"columns {sorted(spark_types)} / {sorted(duck_types)}"
    types = [(n, spark_types[n], duck_types[n]) for n in spark_types if spark_types[n] != duck_types[n]]
    mine = rows_of(frame.columns, frame.collect())
    theirs = rows_of(list(relation.columns), relation.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values\n   {a}\n   {b}"
    return f"types {types}" if types else None


def session(cores: int = 8) -> SparkSession:
    from cairnlog.session import configure

    builder = SparkSession.builder.master(f"local[{cores}]").appName("cairnlog")
    return (
        configure(builder)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(sf_dir: str, parts: list[str]) -> int:
    spark, base, bad = session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, entry in load().items():
        if parts and not any(part in name for part in parts):
            continue
        begin = time.time()
        try:
            frame = entry.run(Tables(spark, sf_dir))
            if entry.sql is None:
                difference, note = None, f"{len(frame.collect())} rows only"
            else:
                difference, note = check(frame, entry.sql, base), ""
        except Exception as error:  # a report of all queries must not stop at one
            difference, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += difference is not None
        print(f"{'ok ' if difference is None else 'BAD'} {time.time() - begin:5.1f}s {name} {note}")
        if difference is not None:
            print("   ", difference[:1800])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
