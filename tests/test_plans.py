"""Physical plans: what is pushed down, how joins are made, and what must not appear."""

import re

import pytest

import __spark_entry__ as entry_module
from tierflow.operators import combine, preview, write_files
from tierflow.plans import job_queue_depth, transform_sql
from tierflow.queries.history import ledger
from tierflow.queries.registry import table

QUERIES = entry_module.queries()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """Plans as they look when no table is small enough to broadcast by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_product(spark, small_dir, no_small_tables, name):
    text = plan(QUERIES[name](spark, small_dir))
    for word in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_filter_and_columns_reach_the_scan(spark, small_dir):
    text = plan(QUERIES["p_filter_predicates"](spark, small_dir))
    assert "GreaterThanOrEqual(l_quantity,5.0)" in text and "In(l_returnflag, [A,R])" in text
    columns = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_tax" not in columns and "l_extendedprice" not in columns


def test_filter_passes_view_and_union(spark, small_dir):
    orders = table(spark, small_dir, "orders")
    sql = "SELECT o_custkey FROM source_data WHERE o_totalprice > 1000"
    text = plan(transform_sql(spark, combine([orders, orders]), sql))
    assert text.count("GreaterThan(o_totalprice,1000.0)") == 2
    assert text.count("ReadSchema: struct<o_custkey:bigint,o_totalprice:double>") == 2


def test_flagship_aggregates_before_it_shuffles(spark, small_dir):
    text = plan(QUERIES["sql_spend_and_count"](spark, small_dir))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


def test_lines_shrink_before_the_join(spark, small_dir, no_small_tables):
    text = plan(QUERIES["p_join_inner"](spark, small_dir))
    assert "SortMergeJoin" in text
    below = text[text.index("SortMergeJoin") :]
    assert below.count("HashAggregate") == 2


def test_checked_small_tables_are_broadcast(spark, small_dir, no_small_tables):
    assert plan(QUERIES["p_join_broadcast"](spark, small_dir)).count("BroadcastHashJoin") == 2


def test_topk_and_preview_do_not_sort_everything(spark, small_dir):
    for frame in (QUERIES["p_topk"](spark, small_dir), QUERIES["preview_ordered"](spark, small_dir)):
        assert "TakeOrderedAndProject" in plan(frame)
    assert "Exchange" not in plan(preview(table(spark, small_dir, "orders")))


def test_dedup_limits_each_key_on_both_sides_of_the_shuffle(spark, small_dir):
    text = plan(QUERIES["dedup_latest"](spark, small_dir))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_row_counts_read_no_columns(spark, small_dir):
    text = plan(QUERIES["row_counts"](spark, small_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {""}


def test_queue_depth_windows_follow_the_calendar(spark, small_dir):
    text = plan(job_queue_depth(ledger(spark, small_dir)))
    # The one unpartitioned window reads one row per hour: it lies above the hourly aggregate.
    single = text.index("SinglePartition")
    assert text.count("SinglePartition") == 1
    assert "HashAggregate(keys=[period" in text[single:]


def test_layout_write_uses_rebalance(spark, small_dir):
    frame = table(spark, small_dir, "orders").hint("rebalance", "o_orderstatus")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(frame)


def test_input_is_read_once_by_a_counted_write(spark, small_dir, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted-write", "")
    try:
        source = table(spark, small_dir, "orders")
        assert write_files(source, str(tmp_path / "out")) == 1500
        assert len(tracker.getJobIdsForGroup("counted-write")) <= 2  # schema footer, write
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
