"""Named queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, connection, name):
    query = entry.queries()[name]
    if name not in SQL:
        assert query(spark, FOLDER).count() > 0
        return
    names, more, less, total = difference(spark, connection, query, SQL[name], FOLDER)
    assert not names and not more and not less
    assert total > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
