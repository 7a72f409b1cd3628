"""Every registered query against DuckDB over the same files."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry_module
from tierflow.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small_dir):
    connection = connect(small_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, duck, name):
    frame = QUERIES[name](spark, small_dir)
    if name in ORACLES:
        assert differences(frame, duck, ORACLES[name]) == []
    else:
        assert frame.count() > 0


def test_only_estimates_lack_checking_sql():
    assert set(QUERIES) - set(ORACLES) == {"p_agg_approx"}


def test_entry_gives_the_flagship_rows(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["customer_id", "total_spent", "order_count"]
    assert frame.count() > 0
