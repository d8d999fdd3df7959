"""Every query against its SQL, on the smallest tables."""

import pytest

from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 5
    assert set(contract.queries()) >= set(QUERIES)
