"""Every query with SQL agrees with DuckDB on the smallest data; the others return rows."""

import pytest

import __spark_entry__ as contract
from tests import oracle
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    problem, rows, _ = oracle.compare(spark, duck, SF, name)
    assert problem is None
    if name not in contract.oracle_sql():
        assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
