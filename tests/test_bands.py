"""Joins by containment and overlap against comparing everything."""

import random

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tierflow.operators import overlap_join, point_join
from tierflow.operators.bands import bins_of, cover
from tierflow.queries import ORACLES, QUERIES


def make(seed):
    rng = random.Random(seed)
    points = [(i, None if rng.random() < 0.05 else 50 if rng.random() < 0.3 else rng.randint(-300, 700), rng.randint(0, 2)) for i in range(150)]
    spans = []
    for i in range(80):
        low = None if rng.random() < 0.05 else rng.randint(-400, 700)
        high = None if low is None or rng.random() < 0.05 else low + rng.choice([-3, 0, 1, 2, 17, 100, 900])
        spans.append((i, low, high, rng.randint(0, 2)))
    return [*points, points[0], points[0]], [*spans, spans[3]]


@pytest.mark.parametrize("unit,fan,pieces,keyed", [(1, 16, 1, False), (10, 2, 3, False), (7, 4, 1, True), (1000, 16, 2, False)])
def test_points_against_all_pairs(spark, unit, fan, pieces, keyed):
    points, spans = make(unit)
    a = spark.createDataFrame(points, "id int, bin int, k int")
    b = spark.createDataFrame(spans, "span int, low int, high int, kk int")
    found = point_join(a, b, "bin", "low", "high", unit=unit, fan=fan, pieces=pieces, on=[("k", "kk")] if keyed else [])
    expected = [
        (*p, *s)
        for p in points
        for s in spans
        if None not in (p[1], s[1], s[2]) and s[1] <= p[1] < s[2] and (not keyed or p[2] == s[3])
    ]
    assert found.columns == [*a.columns, *b.columns]
    assert sorted(map(tuple, found.collect())) == sorted(expected) and expected
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("unit,fan", [(1, 16), (25, 2)])
def test_overlaps_against_all_pairs(spark, unit, fan):
    _, spans = make(9)
    a = spark.createDataFrame(spans, "x int, a int, b int, k int")
    b = spark.createDataFrame(spans, "y int, c int, d int, m int")
    found = overlap_join(a, b, ("a", "b"), ("c", "d"), unit=unit, fan=fan)
    good = [s for s in spans if None not in s and s[1] < s[2]]
    expected = [(*s, *t) for s in good for t in good if s[1] < t[2] and t[1] < s[2]]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("fan", [2, 16])
def test_covers_are_apart_whole_and_short(spark, fan):
    rng = random.Random(fan)
    rows = [(a, a + rng.choice([0, 1, 5, 31, 255, 4097, 60_000])) for a in (rng.randint(-5000, 5000) for _ in range(60))]
    frame = spark.createDataFrame(rows, "a bigint, b bigint")
    levels = 17 if fan == 2 else 4
    for r in frame.select("a", "b", cover(F.col("a"), F.col("b"), levels, fan).alias("c")).collect():
        held = []
        for x in r.c:
            width = fan**x.level
            held.append((x.bin * width, (x.bin + 1) * width))
        held.sort()
        assert len(held) <= 2 * fan * levels
        assert [h[0] for h in held[1:]] == [h[1] for h in held[:-1]]
        assert not held or (held[0][0], held[-1][1]) == (r.a, r.b)
        assert bool(held) == (r.a < r.b)
    bins = spark.createDataFrame([(-1,)], "p bigint").select(bins_of(F.col("p"), 3, 16).alias("x")).first().x
    assert [(b.level, b.bin) for b in bins] == [(0, -1), (1, -1), (2, -1)]


def test_types_and_refusals(spark):
    a = spark.sql("SELECT DATE '2024-01-05' AS d, 1 AS id")
    b = spark.sql("SELECT DATE '2024-01-01' AS f, DATE '2024-02-01' AS t UNION ALL SELECT DATE '2024-01-06', DATE '2024-01-09'")
    assert point_join(a, b, "d", "f", "t").count() == 1
    assert point_join(a, b.limit(0), "d", "f", "t").count() == 0
    for wrong in (lambda: point_join(a, a, "d", "d", "d"), lambda: point_join(a, b, "d", "f", "t", unit=0), lambda: point_join(a, b, "d", "f", "t", fan=3)):
        with pytest.raises(ValueError):
            wrong()
    text = spark.sql("SELECT 'x' AS s")
    with pytest.raises(ValueError, match="whole numbers"):
        point_join(text, b, "s", "f", "t").count()


@pytest.mark.parametrize("keyed", [False, True])
def test_totals_of_overlaps_against_all_pairs(spark, keyed):
    _, spans = make(9)
    values = [(*s, None if s[0] % 9 == 0 else (s[0] - 40) * 10**15) for s in spans]
    a = spark.createDataFrame([*spans, spans[5]], "n int, a int, b int, k int")
    b = spark.createDataFrame(values, "y int, c int, d int, m int, v bigint")
    on = [("k", "m")] if keyed else []
    found = overlap_join(a, b, ("a", "b"), ("c", "d"), totals={"all": "v", "ys": "y"}, count="pairs", on=on)
    expected = []
    for s in [*spans, spans[5]]:
        its = [t for t in values if None not in (s[1], s[2], t[1], t[2]) and s[1] < s[2] and t[1] < t[2]]
        its = [t for t in its if s[1] < t[2] and t[1] < s[2] and (not keyed or s[3] == t[3])]
        if its:
            some = [t[4] for t in its if t[4] is not None]
            expected.append((*s, len(its), sum(some) if some else None, sum(t[0] for t in its)))
    assert found.columns == [*a.columns, "pairs", "all", "ys"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str) and expected
    for wrong in ({"n": "v"}, {"x": "w"}):
        with pytest.raises(ValueError):
            overlap_join(a, b.withColumn("w", F.lit(0.5)), ("a", "b"), ("c", "d"), totals=wrong).count()


def test_overlap_query_makes_no_pairs(spark, tmp_path):
    """Rows between the steps grow with the two sides, not with the 1.6 million pairs of 200 visits and ranges."""
    start = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    events = spark.range(400).selectExpr("id AS event_id", "id div 2 AS user_id", f"{start} + make_dt_interval(0, 23 * (id % 2)) AS ts")
    orders = spark.range(0, 8000).selectExpr("id * 7 AS o_orderkey", "id AS o_custkey", "'P' AS o_orderstatus")
    events.write.parquet(f"{tmp_path}/events.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["p_join_overlap"](spark, str(tmp_path))
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # Only the two tables that were written meet, by the number of a row.
    assert "own_bin" not in text and text.count("Join Inner") == 1
    assert differences(found, connect(str(tmp_path)), ORACLES["p_join_overlap"]) == []
    assert found.count() == 200
