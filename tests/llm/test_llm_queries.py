import pytest

from brindle.llm.queries import QUERIES, SQL
from tests.compare import same
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        same(QUERIES[name](spark, DATA), duck, SQL[name])
    else:
        rows = QUERIES[name](spark, DATA)
        assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
