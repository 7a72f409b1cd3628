from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tierflow.operators import (
    ForeignKey,
    InRange,
    InSet,
    KeyLimits,
    Matches,
    NotNull,
    Unique,
    broadcast_if_small,
    check_quality,
    clean,
    dedup_exact,
    dedup_latest,
    flag_quality,
    gold_aggregate,
    preview,
    row_counts,
    schema_report,
    split_quality,
    standardize,
)

ROWS = [
    (1, 10, "a", "x1", 1),
    (2, 99, "b", "x2", 2),
    (2, None, "z", "bad", 9),
    (None, 5, None, None, None),
    (None, 6, "a", "x3", 1),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, amount int, kind string, code string, parent int")


@pytest.fixture
def rules(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,), (None,)], "pid int")
    return [
        NotNull("id_present", "id"),
        InRange("amount_range", "amount", 0, 50),
        InSet("kind_known", "kind", ("a", "b")),
        Matches("code_pattern", "code", "^x[0-9]$"),
        Unique("id_unique", ("id",)),
        ForeignKey("parent_known", "parent", parents, "pid"),
    ]


def test_quality_report(rows, rules):
    report = {r["rule"]: (r["checked"], r["failed"]) for r in check_quality(rows, rules).collect()}
    assert report == {
        "id_present": (5, 2),
        "amount_range": (5, 1),
        "kind_known": (5, 1),
        "code_pattern": (5, 1),
        "id_unique": (5, 2),
        "parent_known": (5, 1),
    }


def test_report_of_no_rows_is_zero(rows, rules):
    report = check_quality(rows.limit(0), rules).collect()
    assert len(report) == 6 and all(r["checked"] == r["failed"] == 0 for r in report)


def test_quarantine_names_the_broken_rules(rows, rules):
    passed, quarantined = split_quality(rows, rules)
    assert [tuple(r) for r in passed.collect()] == [ROWS[0]]
    broken = {(r["id"], r["amount"]): r["_failed_rules"] for r in quarantined.collect()}
    assert broken == {
        (2, 99): ["amount_range", "id_unique"],
        (2, None): ["kind_known", "code_pattern", "id_unique", "parent_known"],
        (None, 5): ["id_present"],
        (None, 6): ["id_present"],
    }


LIMITS = {
    "broadcast": KeyLimits(),
    "shuffled": KeyLimits(broadcast_bytes=0),
    "in pieces": KeyLimits(broadcast_bytes=0, rows_per_piece=500),
}


@pytest.mark.parametrize("limits", LIMITS.values(), ids=LIMITS.keys())
def test_flagging_keeps_every_row_under_skew(spark, limits):
    # One key holds a third of the rows, another third has no key at all.
    rows = spark.range(30_000).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id END AS `a key`"
    )
    parents = spark.range(20_000).withColumnRenamed("id", "pid")
    rules = [Unique("k_unique", ("a key",)), ForeignKey("k_known", "a key", parents, "pid")]
    flagged = flag_quality(rows, rules, limits)
    counts = {
        tuple(r["_failed_rules"]): r["count"]
        for r in flagged.groupBy("_failed_rules").count().collect()
    }
    values = [7 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(30_000)]
    sizes = Counter(values)
    expected = Counter()
    for v in values:
        repeated = ("k_unique",) if v is not None and sizes[v] > 1 else ()
        orphaned = ("k_known",) if v is not None and v >= 20_000 else ()
        expected[repeated + orphaned] += 1
    assert counts == dict(expected)
    assert flagged.select("id").distinct().count() == 30_000


def test_marking_picks_the_cheapest_join(spark):
    rows = spark.range(1000).selectExpr("id", "id % 10 AS k")

    def joins(rule, limits):
        plan = flag_quality(rows, [rule], limits)._jdf.queryExecution().executedPlan().toString()
        return [word for word in ("BroadcastHashJoin", "SortMergeJoin", "Exchange hash") if word in plan]

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert joins(Unique("u", ("id",)), KeyLimits()) == []
        assert joins(Unique("u", ("k",)), KeyLimits()) == ["BroadcastHashJoin"]
        shuffled = joins(Unique("u", ("k",)), KeyLimits(broadcast_bytes=500))
        assert {"SortMergeJoin", "Exchange hash"} <= set(shuffled)
    finally:
        spark.conf.set(key, before)


def test_crowded_key_is_spread_over_tasks(spark):
    # With adaptive execution off, rows stay where the shuffle of the join has put them.
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60_000, 1, 4).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
        rule = [Unique("k_unique", ("k",))]

        def largest_share(limits):
            flagged = flag_quality(rows, rule, limits).filter("k = 7")
            placed = flagged.groupBy(F.spark_partition_id().alias("p")).count()
            return placed.agg(F.max("count") / F.sum("count")).head()[0]

        assert largest_share(LIMITS["shuffled"]) == 1.0
        assert largest_share(KeyLimits(broadcast_bytes=0, rows_per_piece=100)) < 0.5
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_standardize(spark):
    raw = spark.createDataFrame([("1", "x", 2.0), ("no", "y", None)], "`Cust ID` string, n string, `V-1` double")
    done = standardize(raw, "v_1 int, cust_id bigint, extra date")
    assert done.dtypes == [("v_1", "int"), ("cust_id", "bigint"), ("extra", "date")]
    assert [tuple(r) for r in done.collect()] == [(2, 1, None), (None, None, None)]
    with pytest.raises(ValueError, match="both"):
        standardize(spark.sql("SELECT 1 AS `a b`, 2 AS a_b"), "a_b int")


def test_clean(spark):
    raw = spark.createDataFrame([(" a ", 1), ("  ", 2), ("", None), (None, None)], "t string, n int")
    assert [tuple(r) for r in clean(raw).collect()] == [("a", 1), (None, 2)]


def test_dedup_latest_with_a_crowded_key(spark):
    rows = spark.range(9_000).selectExpr("if(id % 3 = 0, -1, id % 100) AS k", "id AS v", "id % 7 AS w")
    best = {r["k"]: (r["w"], r["v"]) for r in dedup_latest(rows, ["k"], [F.desc("w"), "v"]).collect()}
    expected = {}
    for i in range(9_000):
        k = -1 if i % 3 == 0 else i % 100
        old = expected.get(k)
        if old is None or (-(i % 7), i) < (-old[0], old[1]):
            expected[k] = (i % 7, i)
    assert best == expected


def test_dedup_treats_nulls_as_one_key(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (1, 3)], "k int, v int")
    assert sorted(r["v"] for r in dedup_latest(rows, ["k"], [F.desc("v")]).collect()) == [2, 3]
    assert dedup_exact(rows).count() == 3


def test_gold_aggregate(spark):
    rows = spark.createDataFrame(
        [("a", datetime(2024, 1, 5), 1), ("a", datetime(2024, 1, 9), 2), ("b", datetime(2024, 2, 1), 3)],
        "d string, ts timestamp_ntz, v int",
    )
    monthly = gold_aggregate(rows, ["d"], {"total": F.sum("v")}, grain="month", ts="ts")
    assert sorted(map(tuple, monthly.collect())) == [
        ("a", datetime(2024, 1, 1), 3),
        ("b", datetime(2024, 2, 1), 3),
    ]
    assert gold_aggregate(rows, ["d"], {"n": F.count("*")}).columns == ["d", "n"]
    with pytest.raises(ValueError):
        gold_aggregate(rows, ["d"], {"n": F.count("*")}, grain="month")


def test_profile(spark):
    frame = spark.range(30)
    assert {r["source"]: r["row_count"] for r in row_counts({"a": frame, "b": frame.limit(4)}).collect()} == {
        "a": 30,
        "b": 4,
    }
    assert preview(frame).count() == 10
    assert [r["id"] for r in preview(frame, 2, [F.desc("id")]).collect()] == [29, 28]
    assert [tuple(r) for r in schema_report(frame).collect()] == [("id", "bigint", False)]


def test_broadcast_only_below_the_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert "hint" in big.hint("broadcast")._jdf.queryExecution().logical().toString().lower()
    assert "hint" in broadcast_if_small(big)._jdf.queryExecution().logical().toString().lower()
    assert "hint" not in broadcast_if_small(big, 999)._jdf.queryExecution().logical().toString().lower()


def test_few_wide_rows_are_not_broadcast(spark, tmp_path):
    wide = spark.range(300).selectExpr("id", "array_join(transform(sequence(1, 2000), x -> uuid()), '') AS t")
    wide.write.parquet(str(tmp_path / "wide"))
    back = spark.read.parquet(str(tmp_path / "wide"))
    assert "hint" not in broadcast_if_small(back, 1 << 20)._jdf.queryExecution().logical().toString().lower()
