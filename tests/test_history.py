import random
from datetime import datetime, timedelta

import pytest

from tierflow.plans import (
    ingest_status,
    job_duration_stats,
    job_events,
    job_metrics,
    job_queue_depth,
    job_resource_usage,
    job_status,
    job_success_rate,
    list_jobs,
)
from tierflow.plans.ledger import EVENTS_SCHEMA, RUNS_SCHEMA

START = datetime(2024, 5, 1, 12, 0, 0)


def _at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def _runs(spark, rows):
    """Rows of ``run_id, state, submitted, started, finished, recorded`` (seconds), and extras."""
    full = []
    for run_id, state, submitted, started, finished, recorded, *extra in rows:
        values = dict.fromkeys(RUNS_SCHEMA.fieldNames())
        values |= {
            "run_id": run_id,
            "spark_application": f"sql-exec-{run_id}",
            "state": state,
            "submitted_at": _at(submitted),
            "started_at": _at(started),
            "finished_at": _at(finished),
            "recorded_at": _at(recorded),
            "executor_instances": 2,
            "executor_cores": 3,
            "driver_cores": 1,
            **(extra[0] if extra else {}),
        }
        full.append(tuple(values[name] for name in RUNS_SCHEMA.fieldNames()))
    return spark.createDataFrame(full, RUNS_SCHEMA)


def test_newest_row_counts(spark):
    runs = _runs(
        spark,
        [
            ("a", "SUBMITTED", 0, None, None, 0),
            ("a", "RUNNING", 0, 5, None, 5),
            ("a", "COMPLETED", 0, 5, 5, 5),
            ("b", None, 1, None, None, 1),
        ],
    )
    assert {r["run_id"]: r["state"] for r in job_status(runs).collect()} == {
        "a": "COMPLETED",
        "b": "UNKNOWN",
    }
    assert job_status(runs, "c").count() == 0


def test_metrics(spark):
    runs = _runs(spark, [("a", "COMPLETED", 0, 5, 65, 65), ("b", "RUNNING", 0, 5, None, 5)])
    rows = {r["run_id"]: r for r in job_metrics(runs).collect()}
    assert rows["a"]["duration_seconds"] == 60 and rows["b"]["duration_seconds"] is None
    assert rows["a"]["submission_attempts"] == rows["a"]["execution_attempts"] == 0


def test_list_filters_before_it_limits(spark):
    rows = [(f"f{i}", "FAILED", i, i, i, i, {"error_message": "x" * (199 + i)}) for i in range(3)]
    rows += [(f"c{i:02}", "COMPLETED", 100 + i, 100, 100, 100) for i in range(30)]
    rows += [("n", "FAILED", None, None, None, 0), ("z", "FAILED", 2, 2, 2, 2, {"spark_application": "other"})]
    runs = _runs(spark, rows)
    listed = list_jobs(runs, limit=3, state="failed").collect()
    assert [r["run_id"] for r in listed] == ["f2", "f1", "f0"]
    assert [len(r["error_message"]) for r in listed] == [203, 200, 199]
    assert listed[0]["error_message"].endswith("x...")
    assert [r["run_id"] for r in list_jobs(runs, limit=40).collect()][-1] == "n"
    assert list_jobs(runs).count() == 20


def test_timeline_puts_missing_times_first(spark):
    app = spark.createDataFrame(
        [("a", _at(9), "Normal", "Done", "m", "o"), ("b", _at(1), "Normal", "Begin", "m", "o")], EVENTS_SCHEMA
    )
    driver = spark.createDataFrame([("a", None, "Warning", "Wait", "m", "p")], EVENTS_SCHEMA)
    assert [r["reason"] for r in job_events(app, driver).collect()] == ["Wait", "Begin", "Done"]
    assert [r["reason"] for r in job_events(app, driver, "a").collect()] == ["Wait", "Done"]
    assert job_events(app).count() == 2


def test_rates_durations_and_usage(spark):
    day = 86_400
    runs = _runs(
        spark,
        [
            ("a", "COMPLETED", 0, 0, 10, 10),
            ("b", "COMPLETED", 0, 0, 20, 20),
            ("c", "FAILED", 0, 0, 30, 30),
            ("d", "RUNNING", day, day, None, day),
        ],
    )
    rates = {r["period"].day: r for r in job_success_rate(runs).collect()}
    assert rates[1]["success_rate"] == pytest.approx(2 / 3) and rates[2]["success_rate"] is None
    stats = {r["state"]: r for r in job_duration_stats(runs).collect()}
    assert set(stats) == {"COMPLETED", "FAILED"}
    assert (stats["COMPLETED"]["p50_seconds"], stats["COMPLETED"]["p95_seconds"]) == (15, 19.5)
    usage = job_resource_usage(runs).collect()
    assert [(r["runs"], r["executor_core_seconds"], r["driver_core_seconds"]) for r in usage] == [(3, 360, 60)]


def _depth_by_hand(runs, grain_seconds):
    changes = {}
    for submitted, started in runs:
        changes.setdefault(int(submitted), [0, 0])[0] += 1
        if started is not None:
            changes.setdefault(int(started), [0, 0])[1] += 1
    depth, periods = 0, {}
    for second in sorted(changes):
        up, down = changes[second]
        entry = periods.setdefault(second // grain_seconds, [0, 0, None, 0])
        entry[0] += up
        entry[1] += down
        peak = depth + up
        entry[2] = peak if entry[2] is None else max(entry[2], peak)
        depth += up - down
        entry[3] = depth
    return {period: tuple(entry) for period, entry in periods.items()}


@pytest.mark.parametrize("grain, seconds", [("hour", 3600), ("minute", 60)])
def test_queue_depth_against_a_plain_loop(spark, grain, seconds):
    pick = random.Random(7)
    # A third of all runs falls into one minute.
    submitted = [pick.uniform(0, 40_000) for _ in range(400)] + [pick.uniform(7200, 7260) for _ in range(200)]
    pairs = [(s, None if pick.random() < 0.1 else s + pick.uniform(0, 3000)) for s in submitted]
    runs = _runs(spark, [(f"r{i}", "RUNNING", s, b, None, s) for i, (s, b) in enumerate(pairs)])
    got = {
        int((r["period"] - START).total_seconds()) // seconds: (
            r["submitted"],
            r["started"],
            r["peak_depth"],
            r["end_depth"],
        )
        for r in job_queue_depth(runs, grain).collect()
    }
    assert got == _depth_by_hand(pairs, seconds)


def test_ingest_status(spark):
    rows = [
        ("pg", "COMPLETED", _at(5), _at(5), "basic", 60),
        ("pg", "FAILED", _at(9), _at(9), "basic", 60),
        ("kafka", "RUNNING", None, _at(1), "manual", None),
    ]
    runs = spark.createDataFrame(
        rows,
        "name string, state string, finished_at timestamp, recorded_at timestamp, schedule_type string, "
        "interval_seconds int",
    )
    found = {r["name"]: r for r in ingest_status(runs).collect()}
    assert (found["pg"]["status"], found["pg"]["last_sync"], found["pg"]["next_sync"]) == (
        "FAILED",
        _at(9),
        _at(69),
    )
    assert (found["kafka"]["status"], found["kafka"]["last_sync"], found["kafka"]["next_sync"]) == (
        "RUNNING",
        None,
        None,
    )
    assert ingest_status(runs, "pg").count() == 1
