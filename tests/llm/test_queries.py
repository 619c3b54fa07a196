"""Every query of the subpackage over the given tables, with its SQL where there is one."""

import pytest

from cairnlog.llm.queries import ORACLE_SQL, QUERIES
from catalog.compare import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, base, name):
    frame = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert check(frame, ORACLE_SQL[name], base) is None
    else:
        assert frame.count() > 0
