"""Every registered query against its SQL, whole results."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    if name in ORACLES:
        assert difference(spark, con, name, QUERIES[name], ORACLES[name], sf) is None
    else:
        df = QUERIES[name](spark, sf)
        assert df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
