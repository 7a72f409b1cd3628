"""Run history queries over a ledger derived from the events table.

Every event stands for one run. As in the real ledger a run has one row per state change; the
checking SQL starts from the final row of each run instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.plans import history
from tierflow.queries.registry import query, table

FINAL_RUNS = """
    WITH typed AS (
        SELECT event_id, user_id, ts, event_type, printf('%08x', event_id) AS run_id,
               CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'RUNNING'
                               WHEN 'signup' THEN 'SUBMITTED' ELSE 'COMPLETED' END AS reached
        FROM events
    ), timed AS (
        SELECT *, CASE WHEN reached <> 'SUBMITTED' THEN ts + to_seconds(event_id % 600) END AS started_at
        FROM typed
    ), runs AS (
        SELECT run_id, 'sql-exec-' || run_id AS spark_application, event_id, user_id,
               CASE WHEN event_type = 'view' AND event_id % 50 = 0 THEN NULL ELSE reached END AS state,
               CASE WHEN reached = 'FAILED' THEN
                   CASE WHEN event_id % 2 = 0 THEN repeat('task lost; ', 30) ELSE 'task lost' END
               END AS error_message,
               ts AS submitted_at, started_at,
               CASE WHEN reached IN ('FAILED', 'COMPLETED')
                    THEN started_at + to_seconds(user_id % 900) END AS finished_at,
               CAST(1 + event_id % 4 AS INTEGER) AS executor_instances,
               CAST(1 + user_id % 2 AS INTEGER) AS executor_cores,
               1 AS driver_cores,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1 END AS submission_attempts
        FROM timed
    )
"""


def ledger_from_events(events: DataFrame) -> DataFrame:
    """``runs`` as the ledger holds it: a row when submitted, when started and when ended."""
    reached = (
        F.when(F.col("event_type") == "error", "FAILED")
        .when(F.col("event_type") == "click", "RUNNING")
        .when(F.col("event_type") == "signup", "SUBMITTED")
        .otherwise("COMPLETED")
    )
    lost = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("task lost; "), 30))
    base = (
        events.withColumn("run_id", F.format_string("%08x", "event_id"))
        .withColumn("reached", reached)
        .withColumn("started", F.expr("timestampadd(SECOND, event_id % 600, ts)"))
        .withColumn("ended", F.expr("timestampadd(SECOND, user_id % 900, started)"))
    )
    ended = F.col("reached").isin("FAILED", "COMPLETED")
    nameless = (F.col("event_type") == "view") & (F.col("event_id") % 50 == 0)

    def change(state: Column, at: Column, started: bool, finished: bool, when: Column) -> Column:
        error = F.when(F.col("reached") == "FAILED", F.coalesce(lost, F.lit("task lost")))
        none = F.lit(None)
        entry = F.struct(
            state.alias("state"),
            at.alias("recorded_at"),
            (F.col("started") if started else none.cast("timestamp_ntz")).alias("started_at"),
            (F.col("ended") if finished else none.cast("timestamp_ntz")).alias("finished_at"),
            (error if finished else none.cast("string")).alias("error_message"),
        )
        return F.when(when, entry)

    changes = F.array_compact(
        F.array(
            change(F.lit("SUBMITTED"), F.col("ts"), False, False, F.lit(True)),
            change(
                F.lit("RUNNING"), F.col("started"), True, False, F.col("reached") != "SUBMITTED"
            ),
            change(F.when(~nameless, F.col("reached")), F.col("ended"), True, True, ended),
        )
    )
    return base.select(
        "run_id",
        F.concat(F.lit("sql-exec-"), "run_id").alias("spark_application"),
        F.col("ts").alias("submitted_at"),
        (1 + F.col("event_id") % 4).cast("int").alias("executor_instances"),
        (1 + F.col("user_id") % 2).cast("int").alias("executor_cores"),
        F.lit("512m").alias("executor_memory"),
        F.lit(1).alias("driver_cores"),
        F.lit("512m").alias("driver_memory"),
        F.when(F.col("event_id") % 3 != 0, F.lit(1)).alias("submission_attempts"),
        F.lit(None).cast("int").alias("execution_attempts"),
        F.inline(changes),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_from_events(table(spark, sf_dir, "events"))


@query(
    FINAL_RUNS
    + """
    SELECT run_id, spark_application, COALESCE(state, 'UNKNOWN') AS state, error_message,
           executor_instances AS executor_count, submitted_at AS creation_time
    FROM runs
    """
)
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_status(ledger(spark, sf_dir))


@query(
    FINAL_RUNS
    + """
    , app AS (
        SELECT run_id, submitted_at AS time, 'Submitted' AS reason FROM runs
        UNION ALL SELECT run_id, started_at, 'Started' FROM runs WHERE started_at IS NOT NULL
        UNION ALL SELECT run_id, finished_at, 'Finished' FROM runs WHERE finished_at IS NOT NULL
    )
    SELECT run_id, time, 'Normal' AS type, reason, 'run ' || run_id AS message,
           'SparkApplication/sql-exec-' || run_id AS object FROM app
    UNION ALL
    SELECT run_id, NULL, 'Warning', 'Scheduling', 'no time known',
           'Pod/sql-exec-' || run_id || '-driver'
    FROM runs WHERE event_id % 100 = 0
    """
)
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def event(state: str, column: str, reason: str) -> Column:
        entry = F.struct(F.col(column).alias("time"), F.lit(reason).alias("reason"))
        return F.when(F.col(column).isNotNull(), entry)

    runs = history.latest_runs(ledger(spark, sf_dir))
    moments = F.array_compact(
        F.array(
            event("SUBMITTED", "submitted_at", "Submitted"),
            event("RUNNING", "started_at", "Started"),
            event("ENDED", "finished_at", "Finished"),
        )
    )
    app_events = runs.select("run_id", F.inline(moments)).select(
        "run_id",
        "time",
        F.lit("Normal").alias("type"),
        "reason",
        F.concat(F.lit("run "), "run_id").alias("message"),
        F.concat(F.lit("SparkApplication/sql-exec-"), "run_id").alias("object"),
    )
    driver_events = (
        table(spark, sf_dir, "events")
        .filter(F.col("event_id") % 100 == 0)
        .select(F.format_string("%08x", "event_id").alias("run_id"))
        .select(
            "run_id",
            F.lit(None).cast("timestamp_ntz").alias("time"),
            F.lit("Warning").alias("type"),
            F.lit("Scheduling").alias("reason"),
            F.lit("no time known").alias("message"),
            F.concat(F.lit("Pod/sql-exec-"), "run_id", F.lit("-driver")).alias("object"),
        )
    )
    return history.job_events(app_events, driver_events)


@query(
    FINAL_RUNS
    + """
    SELECT run_id, spark_application, submitted_at AS created_at, started_at, finished_at,
           date_diff('second', started_at, finished_at) AS duration_seconds, driver_cores,
           '512m' AS driver_memory, executor_cores, executor_instances, '512m' AS executor_memory,
           COALESCE(submission_attempts, 0) AS submission_attempts, 0 AS execution_attempts
    FROM runs
    """
)
def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_metrics(ledger(spark, sf_dir))


@query(
    FINAL_RUNS
    + """
    SELECT run_id, spark_application, state, submitted_at AS created_at, started_at, finished_at,
           COALESCE(submission_attempts, 0) AS submission_attempts,
           CASE WHEN length(error_message) > 200 THEN left(error_message, 200) || '...'
                ELSE error_message END AS error_message
    FROM runs WHERE state = 'FAILED' ORDER BY submitted_at DESC, run_id LIMIT 20
    """
)
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.list_jobs(ledger(spark, sf_dir), state="failed")


@query(
    FINAL_RUNS
    + """
    SELECT date_trunc('day', submitted_at) AS period, COUNT(*) AS runs,
           COUNT(*) FILTER (WHERE state = 'COMPLETED') AS succeeded,
           COUNT(*) FILTER (WHERE state = 'FAILED') AS failed,
           CAST(COUNT(*) FILTER (WHERE state = 'COMPLETED') AS DOUBLE)
             / NULLIF(COUNT(*) FILTER (WHERE state IN ('COMPLETED', 'FAILED')), 0) AS success_rate
    FROM runs GROUP BY date_trunc('day', submitted_at)
    """
)
def job_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_success_rate(ledger(spark, sf_dir))


@query(
    FINAL_RUNS
    + """
    , timed_runs AS (
        SELECT COALESCE(state, 'UNKNOWN') AS state,
               date_diff('second', started_at, finished_at) AS s
        FROM runs WHERE finished_at IS NOT NULL
    )
    SELECT state, COUNT(*) AS runs, MIN(s) AS min_seconds,
           CAST(SUM(s) AS DOUBLE) / COUNT(*) AS avg_seconds,
           round(quantile_cont(s, 0.5), 6) AS p50_seconds,
           round(quantile_cont(s, 0.95), 6) AS p95_seconds, MAX(s) AS max_seconds
    FROM timed_runs GROUP BY state
    """
)
def job_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_duration_stats(ledger(spark, sf_dir))


@query(
    FINAL_RUNS
    + """
    SELECT date_trunc('day', submitted_at) AS period, COUNT(*) AS runs,
           CAST(SUM(executor_instances * executor_cores
                    * date_diff('second', started_at, finished_at)) AS BIGINT)
               AS executor_core_seconds,
           CAST(SUM(date_diff('second', started_at, finished_at)) AS BIGINT) AS driver_core_seconds
    FROM runs WHERE finished_at IS NOT NULL GROUP BY date_trunc('day', submitted_at)
    """
)
def job_resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_resource_usage(ledger(spark, sf_dir))


@query(
    FINAL_RUNS
    + """
    , d AS (
        SELECT date_trunc('second', submitted_at) AS s, 1 AS up, 0 AS down FROM runs
        UNION ALL SELECT date_trunc('second', started_at), 0, 1 FROM runs WHERE started_at IS NOT NULL
    ), p AS (SELECT s, SUM(up) AS up, SUM(down) AS down FROM d GROUP BY s),
    w AS (SELECT s, up, down, SUM(up - down) OVER (ORDER BY s) AS depth FROM p)
    SELECT date_trunc('hour', s) AS period, CAST(SUM(up) AS BIGINT) AS submitted,
           CAST(SUM(down) AS BIGINT) AS started, CAST(MAX(depth + down) AS BIGINT) AS peak_depth,
           CAST(arg_max(depth, s) AS BIGINT) AS end_depth
    FROM w GROUP BY date_trunc('hour', s)
    """
)
def job_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.job_queue_depth(ledger(spark, sf_dir))


@query(
    """
    WITH syncs AS (
        SELECT 'sync-' || (user_id % 20) AS name, ts, user_id,
               CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type <> 'view' THEN 'COMPLETED' END
                   AS state,
               CASE WHEN user_id % 2 = 0 THEN 'basic' ELSE 'manual' END AS schedule_type,
               60 + user_id % 20 AS every
        FROM events
    )
    SELECT name, COALESCE(arg_max_null(state, ts), 'unknown') AS status, MAX(ts) AS last_sync,
           CASE WHEN MAX(schedule_type) = 'basic' THEN MAX(ts) + to_seconds(MAX(every)) END AS next_sync,
           MAX(schedule_type) AS schedule_type
    FROM syncs GROUP BY name
    """
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    syncs = table(spark, sf_dir, "events").selectExpr(
        "concat('sync-', user_id % 20) AS name",
        """CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type <> 'view' THEN 'COMPLETED'
           END AS state""",
        "ts AS finished_at",
        "ts AS recorded_at",
        "CASE WHEN user_id % 2 = 0 THEN 'basic' ELSE 'manual' END AS schedule_type",
        "60 + user_id % 20 AS interval_seconds",
    )
    return history.ingest_status(syncs)
