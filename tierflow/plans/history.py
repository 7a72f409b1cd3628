"""Analytics over the run ledger.

All functions take the ledger as it is written, with several rows per run, and look at the newest
row of each run. Time stamps may be with or without zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.operators.dedup import dedup_latest
from tierflow.operators.gold import period

NAME_PREFIX = "sql-exec-"
ERROR_TEXT_LIMIT = 200


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per run. Two changes recorded in one microsecond are told apart by how far they got."""
    order = [
        F.desc_nulls_last("recorded_at"),
        F.desc_nulls_last("finished_at"),
        F.desc_nulls_last("started_at"),
        F.desc_nulls_last("state"),
    ]
    return dedup_latest(runs, ["run_id"], order)


def _seconds(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {start}, {end})")


def _state() -> Column:
    return F.coalesce(F.col("state"), F.lit("UNKNOWN"))


def job_status(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Status of one run or of all; an unknown run gives no row."""
    chosen = runs if run_id is None else runs.filter(F.col("run_id") == run_id)
    return latest_runs(chosen).select(
        "run_id",
        "spark_application",
        _state().alias("state"),
        "error_message",
        F.col("executor_instances").alias("executor_count"),
        F.col("submitted_at").alias("creation_time"),
    )


def get_job(runs: DataFrame, run_id: str) -> dict:
    """Status of one run as a dict; an unknown run raises ``LookupError``."""
    found = job_status(runs, run_id).head(1)
    if not found:
        raise LookupError(f"no run {run_id!r}")
    return found[0].asDict()


def job_events(
    app_events: DataFrame, driver_events: DataFrame | None = None, run_id: str | None = None
) -> DataFrame:
    """Timeline of application and driver events, events without a time first.

    Ties are broken by every other column, so one crowded time value does not end in one task of
    the range sort.
    """
    merged = app_events if driver_events is None else app_events.unionByName(driver_events)
    if run_id is not None:
        merged = merged.filter(F.col("run_id") == run_id)
    return merged.select("run_id", "time", "type", "reason", "message", "object").orderBy(
        F.asc_nulls_first("time"), "run_id", "object", "reason", "type", "message"
    )


def job_metrics(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Timing, resources and attempts; the duration is NULL until a run has started and ended."""
    chosen = runs if run_id is None else runs.filter(F.col("run_id") == run_id)
    return latest_runs(chosen).select(
        "run_id",
        "spark_application",
        F.col("submitted_at").alias("created_at"),
        "started_at",
        "finished_at",
        _seconds("started_at", "finished_at").alias("duration_seconds"),
        "driver_cores",
        "driver_memory",
        "executor_cores",
        "executor_instances",
        "executor_memory",
        F.coalesce("submission_attempts", F.lit(0)).alias("submission_attempts"),
        F.coalesce("execution_attempts", F.lit(0)).alias("execution_attempts"),
    )


def list_jobs(runs: DataFrame, limit: int = 20, state: str | None = None) -> DataFrame:
    """Newest runs first, filtered before the limit is taken."""
    jobs = latest_runs(runs.filter(F.col("spark_application").startswith(NAME_PREFIX)))
    if state:
        jobs = jobs.filter(F.lower(_state()) == state.lower())
    text = F.col("error_message")
    shortened = F.when(
        F.length(text) > ERROR_TEXT_LIMIT,
        F.concat(F.substring(text, 1, ERROR_TEXT_LIMIT), F.lit("...")),
    ).otherwise(text)
    return (
        jobs.select(
            "run_id",
            "spark_application",
            _state().alias("state"),
            F.col("submitted_at").alias("created_at"),
            "started_at",
            "finished_at",
            F.coalesce("submission_attempts", F.lit(0)).alias("submission_attempts"),
            shortened.alias("error_message"),
        )
        .orderBy(F.desc_nulls_last("created_at"), "run_id")
        .limit(limit)
    )


def job_success_rate(runs: DataFrame, grain: str = "day") -> DataFrame:
    """Runs, successes and failures per period of submission; the rate covers ended runs only."""
    done, failed = F.count_if(_state() == "COMPLETED"), F.count_if(_state() == "FAILED")
    return (
        latest_runs(runs)
        .groupBy(period("submitted_at", grain).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            done.alias("succeeded"),
            failed.alias("failed"),
            F.try_divide(done.cast("double"), (done + failed).cast("double")).alias("success_rate"),
        )
    )


def job_duration_stats(runs: DataFrame) -> DataFrame:
    """Run time by state. Percentiles are exact: they work on counts per whole second, whose number
    depends on the longest run and not on how many runs there are."""
    timed = (
        latest_runs(runs)
        .select(_state().alias("state"), _seconds("started_at", "finished_at").alias("s"))
        .filter(F.col("s").isNotNull())
        .groupBy("state", "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return timed.groupBy("state").agg(
        F.sum("n").alias("runs"),
        F.min("s").alias("min_seconds"),
        (F.sum(F.col("s") * F.col("n")).cast("double") / F.sum("n")).alias("avg_seconds"),
        F.round(F.percentile("s", F.lit(0.5), F.col("n")), 6).alias("p50_seconds"),
        F.round(F.percentile("s", F.lit(0.95), F.col("n")), 6).alias("p95_seconds"),
        F.max("s").alias("max_seconds"),
    )


def job_resource_usage(runs: DataFrame, grain: str = "day") -> DataFrame:
    """Core seconds per period of submission, over runs that have ended."""
    seconds = _seconds("started_at", "finished_at")
    executors = F.col("executor_instances").cast("bigint") * F.col("executor_cores")
    return (
        latest_runs(runs)
        .filter(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
        .groupBy(period("submitted_at", grain).alias("period"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum(executors * seconds).alias("executor_core_seconds"),
            F.sum(F.col("driver_cores") * seconds).alias("driver_core_seconds"),
        )
    )


def job_queue_depth(runs: DataFrame, grain: str = "hour") -> DataFrame:
    """Peak and final number of waiting runs per period with any submission or start.

    Resolution is a whole second, and within a second submissions count before starts. A running
    sum over all rows would be one task, so it is cut in two: changes are added up per second, the
    running sum stays inside a period (3,600 rows for an hour, however many runs fall into it), and
    each period adds the depth carried in. The carry is cut in two again: inside a day, over its
    periods, and over one row per day of the whole history, the only window without partitions.
    """
    changes = latest_runs(runs).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("submitted_at").alias("ts"),
                    F.lit(1).alias("submitted"),
                    F.lit(0).alias("started"),
                ),
                F.struct(
                    F.col("started_at").alias("ts"),
                    F.lit(0).alias("submitted"),
                    F.lit(1).alias("started"),
                ),
            )
        )
    )
    per_second = (
        changes.filter(F.col("ts").isNotNull())
        .groupBy(F.date_trunc("second", "ts").alias("second"))
        .agg(F.sum("submitted").alias("submitted"), F.sum("started").alias("started"))
        .withColumn("period", period("second", grain))
    )
    inside = Window.partitionBy("period").orderBy("second")
    net = F.col("submitted") - F.col("started")
    within = per_second.withColumn("net", F.sum(net).over(inside)).groupBy("period").agg(
        F.sum("submitted").alias("submitted"),
        F.sum("started").alias("started"),
        F.max(F.col("net") + F.col("started")).alias("rise"),
    )
    day = F.date_trunc("day", "period")
    daily = within.groupBy(day.alias("day")).agg(F.sum(net).alias("net"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = daily.select(F.col("day"), F.coalesce(F.sum("net").over(before), F.lit(0)).alias("opening"))
    earlier = Window.partitionBy("day").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        within.withColumn("day", day)
        .withColumn("inside", F.coalesce(F.sum(net).over(earlier), F.lit(0)))
        .join(opening, "day")
        .withColumn("carry", F.col("opening") + F.col("inside"))
    )
    return carried.select(
        "period",
        "submitted",
        "started",
        (F.col("carry") + F.col("rise")).alias("peak_depth"),
        (F.col("carry") + net).alias("end_depth"),
    )


def ingest_status(runs: DataFrame, name: str | None = None) -> DataFrame:
    """State, last and next sync per ingest job.

    Expects ``name, state, finished_at, recorded_at, schedule_type, interval_seconds``. The next
    sync is known for interval (``basic``) schedules; a ``manual`` job has none.
    """
    chosen = runs if name is None else runs.filter(F.col("name") == name)
    newest = F.struct("recorded_at", "finished_at", "state")
    last = F.max("finished_at")
    return (
        chosen.groupBy("name")
        .agg(
            F.max_by(F.coalesce("state", F.lit("unknown")), newest).alias("status"),
            last.alias("last_sync"),
            F.max_by("schedule_type", newest).alias("schedule_type"),
            F.max_by("interval_seconds", newest).alias("interval_seconds"),
        )
        .select(
            "name",
            "status",
            "last_sync",
            F.when(
                F.col("schedule_type") == "basic",
                F.expr("timestampadd(SECOND, interval_seconds, last_sync)"),
            ).alias("next_sync"),
            "schedule_type",
        )
    )
