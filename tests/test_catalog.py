"""Every catalog query against DuckDB on the given tables."""

import pytest

from catalog import load
from catalog.compare import check
from catalog.views import Tables

ENTRIES = load()


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query(spark, sf_dir, base, name):
    entry = ENTRIES[name]
    frame = entry.run(Tables(spark, sf_dir))
    assert entry.sql is not None
    assert check(frame, entry.sql, base) is None


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
