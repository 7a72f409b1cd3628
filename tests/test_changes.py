"""Changes to folders: merges in any order, recomputed periods, and calls that were cut off."""

import itertools
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tierflow.operators import changes, upsert, upserted_rows
from tierflow.plans import gold_rows, load_periods, refresh_gold, silver_rows
from tierflow.plans import incremental

FEED = "id bigint, part string, at int, op string, v int"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def feed(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = None if rng.random() < 0.05 else 7 if rng.random() < 0.3 else rng.randint(0, 40)
        rows.append((key, f"p{(key or 0) % 3}", None if rng.random() < 0.02 else rng.randint(0, 200), rng.choice("uuud"), i))
    return rows


def expected(rows):
    """Newest of each key; nothing is certain about equal versions but that it does not depend on the order."""
    newest = {}
    for row in rows:
        at = -1 if row[2] is None else row[2]
        newest.setdefault(row[0], []).append((at, row))
    return {k: {r for a, r in v if a == max(x for x, _ in v)} for k, v in newest.items()}


@pytest.mark.parametrize("by", [(), ("part",)])
def test_batches_in_any_order_give_one_state(spark, tmp_path, by):
    rows = feed(1)
    batches = [rows[:100], rows[100:250], rows[250:]]
    keys = ["id", "part"] if by else ["id"]
    states = []
    for number, order in enumerate(itertools.permutations(range(3))):
        path = str(tmp_path / str(number))
        for b in order:
            frame = spark.createDataFrame(batches[b], FEED)
            upsert(frame, path, keys, ["at"], change_id=f"batch-{b}", deleted=F.col("op") == "d", partition_by=by, buckets=5)
        states.append(sorted(map(tuple, upserted_rows(spark, path).collect()), key=repr))
        if number == 2:
            break
    assert states[0] == states[1] == states[2]
    found, wanted = {r[0]: r for r in states[0]}, expected(rows)
    assert len(found) == len(states[0])
    for key, candidates in wanted.items():
        if any(r[3] == "d" for r in candidates):
            assert key not in found  # a deletion goes before other changes of its version
        else:
            assert found[key] in candidates


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "silver")
    first = spark.createDataFrame([(i, f"p{i % 4}", 1, "u", i) for i in range(40)], FEED)
    assert upsert(first, path, ["part", "id"], ["at"], change_id="a", partition_by=["part"]).partitions == 4
    before = files(path)
    second = spark.createDataFrame([(1, "p1", 2, "u", 100), (5, "p1", 2, "d", 0), (99, "p1", 1, "u", 9)], FEED)
    result = upsert(second, path, ["part", "id"], ["at"], change_id="b", deleted=F.col("op") == "d", partition_by=["part"])
    assert (result.changes, result.partitions, result.rows) == (3, 1, 11)
    after = files(path)
    same = {f for f in before if "part=p1" not in f}
    assert {f: after[f] for f in same} == {f: before[f] for f in same}
    assert not any(f in after for f in before if "part=p1" in f)
    found = {r.id: r.v for r in upserted_rows(spark, path).collect()}
    assert found[1] == 100 and 5 not in found and found[99] == 9 and len(found) == 40


def test_a_batch_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "silver")
    upsert(spark.range(100).withColumn("at", F.lit(1)), path, ["id"], ["at"], change_id="a", buckets=10)
    late = spark.range(1).withColumn("at", F.lit(0))
    result = upsert(late, path, ["id"], ["at"], change_id="b", buckets=10)
    assert result.partitions == 1 and result.rows < 100 and upserted_rows(spark, path).count() == 100


def test_new_columns_nulls_and_refusals(spark, tmp_path):
    path = str(tmp_path / "silver")
    upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, at int, v string"), path, ["id"], ["at"], change_id="a")
    wider = spark.createDataFrame([(2, 2, "c", 5.0), (None, 1, "n", None)], "id int, at int, v string, more double")
    upsert(wider, path, ["id"], ["at"], change_id="b")
    assert sorted(map(tuple, upserted_rows(spark, path).collect()), key=repr) == [(1, 1, "a", None), (2, 2, "c", 5.0), (None, 1, "n", None)]
    assert upsert(wider.limit(0), path, ["id"], ["at"], change_id="c").partitions == 0
    for wrong in ({"keys": ["v"]}, {"version": ["v"]}, {"buckets": 3}):
        options = {"keys": ["id"], "version": ["at"], "change_id": "d", **wrong}
        with pytest.raises(ValueError, match="other"):
            upsert(wider, path, **options)
    with pytest.raises(ValueError, match="not string|is string"):
        upsert(wider.withColumn("v", F.lit(1)), path, ["id"], ["at"], change_id="e")
    with pytest.raises(ValueError):
        upsert(wider, path, ["id"], ["at"], change_id="../x")
    with pytest.raises(ValueError):
        upsert(wider, path, ["id"], ["at"], change_id="f", partition_by=["v"])


class Cut(Exception):
    pass


def cut_at(monkeypatch, number):
    """Let the step with that number, of all that change files, fail before or after its work."""
    seen = itertools.count()

    def wrap(function):
        def step(*args, **options):
            if next(seen) == number:
                raise Cut
            result = function(*args, **options)
            if next(seen) == number:
                raise Cut
            return result

        return step

    for module in (changes, incremental):
        for name in ("write_note", "swap_in", "remove_folder", "write_files"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, wrap(getattr(module, name)))
    return seen


def test_a_merge_cut_off_anywhere_is_finished(spark, tmp_path, monkeypatch):
    first, second = feed(3, 60), feed(4, 60)
    wanted, number = None, -1
    while True:
        path = str(tmp_path / str(number))
        run = lambda rows, i, p=path: upsert(spark.createDataFrame(rows, FEED), p, ["id"], ["at"], change_id=i, deleted=F.col("op") == "d", buckets=3)
        run(first, "a")
        with monkeypatch.context() as patch:
            seen = cut_at(patch, number)
            try:
                run(second, "b")
                finished = next(seen) <= number
            except Cut:
                finished = False
        run(second, "b")
        found = sorted(map(tuple, upserted_rows(spark, path).collect()), key=repr)
        wanted = wanted or found
        assert found == wanted
        assert not Path(changes.staging_path(spark, path, "b")).exists()
        if finished:
            break
        number += 1
    assert number >= 8


START = datetime(2024, 1, 1)


def measures():
    return {"n": F.count(F.lit(1)), "total": F.sum("v"), "users": F.count_distinct("user")}


COLUMNS = ["kind", "period", "n", "total", "users"]



def events(spark, seed, days, n=60):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 9), rng.choice("ab"), START + timedelta(days=rng.choice(days)), rng.randint(0, 9)) for _ in range(n)]
    return spark.createDataFrame([*rows, (1, "a", None, 5)], "user int, kind string, ts timestamp_ntz, v int")


def full(frame):
    keys = ["kind", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period")]
    return sorted(map(tuple, frame.groupBy(*keys).agg(*[m.alias(k) for k, m in measures().items()]).collect()), key=repr)


def test_gold_after_each_load_equals_the_whole(spark, tmp_path):
    silver, gold = str(tmp_path / "silver"), str(tmp_path / "gold")
    seen = None
    for number, days in enumerate([[0, 1, 2, 3], [3, 4], [1]]):
        load = events(spark, number, days)
        seen = load if seen is None else seen.union(load)
        before = files(gold) if number else {}
        note = load_periods(load, silver, f"load-{number}", "ts", "day")
        assert load_periods(load, silver, f"load-{number}", "ts", "day") == note
        touched = refresh_gold(spark, silver, load.schema, gold, ["kind"], measures(), "ts", "day")
        assert touched == note["periods"] == sorted({"none", *[(START + timedelta(days=d)).strftime("%Y-%m-%d-00") for d in days]})
        assert sorted(map(tuple, gold_rows(spark, gold).select(*COLUMNS).collect()), key=repr) == full(seen)
        after = files(gold)
        kept = {f for f in before if not any(f"_period={t}" in f for t in touched)}
        assert {f: after[f] for f in kept} == {f: before[f] for f in kept}
    assert refresh_gold(spark, silver, load.schema, gold, ["kind"], measures(), "ts", "day") == []
    plan = silver_rows(spark, silver, load.schema, ["2024-01-02-00"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_period" in plan


def test_loads_and_refreshes_cut_off_anywhere(spark, tmp_path, monkeypatch):
    first, second = events(spark, 1, [0, 1], 20), events(spark, 2, [1, 2], 20)
    number = 0
    while True:
        silver, gold = str(tmp_path / f"s{number}"), str(tmp_path / f"g{number}")

        def run(frame, name, silver=silver, gold=gold):
            load_periods(frame, silver, name, "ts", "day")
            refresh_gold(spark, silver, frame.schema, gold, ["kind"], measures(), "ts", "day")

        run(first, "a")
        with monkeypatch.context() as patch:
            seen = cut_at(patch, number)
            try:
                run(second, "b")
                finished = next(seen) <= number
            except Cut:
                finished = False
        run(second, "b")
        assert sorted(map(tuple, gold_rows(spark, gold).select(*COLUMNS).collect()), key=repr) == full(first.union(second))
        if finished:
            break
        number += 1
    assert number >= 10
