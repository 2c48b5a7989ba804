"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from oracle import rows, tables

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(con.sql(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
