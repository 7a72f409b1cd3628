"""Windows in pieces against Spark's own windows, with crowded partitions, ties and NULLs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tierflow.operators import Over, ordered_window

COLUMNS = {
    "row_no": Over.row_number(),
    "rank_no": Over.rank(),
    "dense_no": Over.dense_rank(),
    "percent": Over.percent_rank(),
    "tile": Over.ntile(7),
    "rows_so_far": Over.running_count(),
    "values_so_far": Over.running_count("v"),
    "sum_so_far": Over.running_sum("v"),
    "least": Over.running_min("v"),
    "most": Over.running_max("v"),
    "three": Over.moving_sum("v", 2),
    "alone": Over.moving_sum("v", 0),
    "forty": Over.moving_sum("v", 40),
    "first": Over.first_value("v"),
    "before": Over.lag("v"),
    "before5": Over.lag("id", 5, -1),
    "behind": Over.lead("v"),
    "behind6": Over.lead("id", 6, -2),
}


def plain(frame, parts, order, ties):
    by = [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]
    w = Window.partitionBy(*parts).orderBy(*by, *ties)
    rows, ranks = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parts).orderBy(*by)
    return frame.select(
        "*",
        F.row_number().over(w).cast("bigint").alias("row_no"),
        F.rank().over(ranks).cast("bigint").alias("rank_no"),
        F.dense_rank().over(ranks).cast("bigint").alias("dense_no"),
        F.percent_rank().over(ranks).alias("percent"),
        F.ntile(7).over(w).cast("bigint").alias("tile"),
        F.count(F.lit(1)).over(rows).alias("rows_so_far"),
        F.count("v").over(rows).alias("values_so_far"),
        F.sum("v").over(rows).alias("sum_so_far"),
        F.min("v").over(rows).alias("least"),
        F.max("v").over(rows).alias("most"),
        F.sum("v").over(w.rowsBetween(-2, 0)).alias("three"),
        F.sum("v").over(w.rowsBetween(0, 0)).alias("alone"),
        F.sum("v").over(w.rowsBetween(-40, 0)).alias("forty"),
        F.first("v").over(rows).alias("first"),
        F.lag("v").over(w).alias("before"),
        F.lag("id", 5, -1).over(w).alias("before5"),
        F.lead("v").over(w).alias("behind"),
        F.lead("id", 6, -2).over(w).alias("behind6"),
    )


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def make(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"g{rng.randint(0, 12)}"
        day = None if rng.random() < 0.1 else 3 if rng.random() < 0.4 else rng.randint(0, 20)
        rows.append((group, day, i, None if rng.random() < 0.2 else rng.randint(-50, 50)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "`the group` string, `_piece` int, id int, v int").withColumnRenamed("the group", "g.x")


@pytest.mark.parametrize("seed,pieces,parts,direction", [(0, 13, ["g.x"], "asc"), (1, 40, [], "desc"), (2, 3, ["g.x"], "desc"), (3, 60, [], "asc"), (4, 200, ["g.x"], "asc")])
def test_against_spark(spark, seed, pieces, parts, direction):
    frame = make(spark, seed)
    found = ordered_window(frame, COLUMNS, [("_piece", direction)], partition_by=parts, ties=["id"], pieces=pieces)
    expected = plain(frame, [f"`{p}`" for p in parts], [("_piece", direction)], ["id"])
    assert found.columns == expected.columns
    assert rows_of(found) == rows_of(expected)
    assert [t for _, t in found.dtypes] == [t for _, t in expected.dtypes]


def test_everything_is_one_tie(spark):
    """One value in all rows: pieces are cut by the ties, ranks go on across all of them."""
    frame = spark.range(100).select(F.lit("a").alias("k"), "id")
    found = ordered_window(frame, {"r": Over.rank(), "d": Over.dense_rank(), "n": Over.row_number()}, ["k"], ties=["id"], pieces=9)
    assert sorted((r.r, r.d, r.n, r.id) for r in found.collect()) == [(1, 1, i + 1, i) for i in range(100)]


def test_no_task_gets_all_rows(spark, small_dir):
    lines = spark.read.parquet(f"{small_dir}/lineitem.parquet")
    found = ordered_window(lines, {"n": Over.row_number(), "r": Over.rank()}, ["l_shipdate"], ties=["l_orderkey", "l_linenumber"], pieces=16)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text and "Window" in text
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(p) for p in found.select("n").rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < sum(sizes)
    assert sorted(r.n for r in found.select("n").collect()) == list(range(1, 6001))


def test_empty_frames_and_refusals(spark):
    frame = make(spark, 1).limit(0)
    assert ordered_window(frame, COLUMNS, ["id"]).collect() == []
    with pytest.raises(ValueError, match="there already"):
        ordered_window(frame, {"V": Over.row_number()}, ["id"])
    with pytest.raises(ValueError, match="no columns"):
        ordered_window(frame, {"n": Over.row_number()}, ["absent"])
    for wrong in (lambda: Over.lag("v", 0), lambda: Over.ntile(0), lambda: Over.moving_sum("v", -1)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        ordered_window(frame, {}, ["id"])
    with pytest.raises(ValueError):
        ordered_window(frame, {"n": Over.row_number()}, [])
