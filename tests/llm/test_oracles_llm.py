"""Queries of the subpackage against their oracle SQL, and the contract of the entry point."""

from types import SimpleNamespace

import pytest

from oracle import compare, connect
from spoor.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    problem, rows = compare(spark, connect(SF), name, SimpleNamespace(run=QUERIES[name], oracle=ORACLES[name]), SF)
    assert problem is None and rows > 0


def test_each_operator_has_a_query():
    import __spark_entry__ as entry

    found = entry.queries()
    assert "pipeline" in found
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= set(found) and set(ORACLES) <= set(entry.oracle_sql())
