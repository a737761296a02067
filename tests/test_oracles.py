"""Every registered query against its oracle SQL."""

import pytest

from oracle import compare, connect
from spoor.plans.registry import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(load()))
def test_query_matches_oracle(spark, con, name):
    problem, _ = compare(spark, con, name, load()[name], SF)
    assert problem is None


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
