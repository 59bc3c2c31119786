"""Every registered query against its SQL at the smallest scale; the others must give rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from parity import compare, connect

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) is None


# the smallest panel has too few positive rows to resample
LARGER = {"train_and_select": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, LARGER.get(name, small)).count() > 0


def test_entry(spark):
    rows = {r["split"]: r for r in entry(spark).collect()}
    assert set(rows) == {"train", "val", "test"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
