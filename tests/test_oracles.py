"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.compare import connect, difference

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, folder, name):
    assert difference(spark, duck, folder, name) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_entry_counts_every_page_once(spark):
    assert entry.entry(spark).groupBy().sum("books").collect()[0][0] == 50
