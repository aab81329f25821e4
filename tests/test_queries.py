"""Every query of the core on the smallest tables, against SQL where there is some."""

import pytest

from brindle.plans import MODULES
from tests.compare import same
from tests.conftest import DATA

QUERIES = {n: (q, m.SQL.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query, sql = QUERIES[name]
    if sql:
        same(query(spark, DATA), duck, sql)
    else:
        assert query(spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
