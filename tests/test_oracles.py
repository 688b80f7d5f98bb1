"""Every registered query against its SQL, over the whole small tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    names, got = spark_rows(QUERIES[name](spark, SF_DIR))
    sql_names, wanted = sql_rows(con, ORACLES[name])
    assert names == sql_names
    assert sum(wanted.values()) > 0
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 120
