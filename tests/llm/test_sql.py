import pytest
from compare import connect, difference
from conftest import SF

from tonewright.llm.queries import QUERIES
from tonewright.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None
