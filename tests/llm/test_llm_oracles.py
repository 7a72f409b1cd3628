"""Registered queries against DuckDB over the same files."""

import pytest
from compare import connect, differences

from tierflow.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small_dir, name):
    assert differences(QUERIES[name](spark, small_dir), connect(small_dir), ORACLES[name]) == []


def test_every_operator_has_a_query():
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14))
