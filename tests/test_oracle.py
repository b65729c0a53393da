import pytest
from compare import connect, difference
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert difference(queries()[name](spark, SF), duck, SQL[name]) is None


def test_entry_and_names(spark):
    assert set(SQL) <= set(queries())
    assert entry(spark).count() == 5
