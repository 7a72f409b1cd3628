"""Nothing that exists may be lost by a write, a replacement, a resumed run or a late row."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierflow.__main__ import job_arguments, report, run_job
from tierflow.functions import exact_sum
from tierflow.operators import InRange, NotNull, Unique, dedup_latest, flag_quality, publish_table, standardize, write_files, write_quality
from tierflow.operators.combine import combine
from tierflow.plans import RunLedger, Step, ingest, run_layers, run_transform
from tierflow.plans.history import ingest_status, job_queue_depth, job_resource_usage
from tierflow.sources import scan, scan_all
from tierflow.sources.connectors import PostgresConfig, scan_jdbc
from tierflow.streaming import ingest_stream, merge_stream, merged_rows, stream_files


@pytest.fixture
def kept(spark, tmp_path):
    path = str(tmp_path / "kept")
    write_files(spark.range(10), path)
    return path


def test_a_frame_cannot_overwrite_what_it_reads(spark, kept, tmp_path):
    frame = spark.read.parquet(kept)
    frame.createOrReplaceTempView("kept_view")
    other = spark.range(3)
    for reader in (frame, spark.table("kept_view"), other.join(frame, "id"), spark.sql("SELECT * FROM range(5) WHERE id IN (SELECT id FROM kept_view)")):
        with pytest.raises(ValueError, match="overlaps"):
            write_files(reader, kept)
    for sources in (frame, {"source_data": frame}, {"a": other, "source_data": spark.table("kept_view")}):
        with pytest.raises(ValueError, match="overlaps"):
            run_transform(spark, "SELECT * FROM source_data", sources, kept)
    bronze = str(tmp_path / "bronze" / "kept")
    write_files(spark.range(4), bronze)
    with pytest.raises(ValueError, match="overlaps"):
        run_layers(spark, str(tmp_path), {"raw": scan(spark, bronze)}, [Step("kept", "bronze", ["raw"], "SELECT id FROM raw")])
    assert spark.read.parquet(bronze).count() == 4
    assert spark.read.parquet(kept).count() == 10


def _failing(spark):
    return spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("bigint")).alias("id"))


@pytest.mark.parametrize("own_path", [False, True])
def test_a_failed_replace_keeps_the_table(spark, tmp_path, own_path):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS spark_catalog.guards")
    name = f"spark_catalog.guards.replaced_{own_path}".lower()
    path = str(tmp_path / "table") if own_path else None
    publish_table(spark.range(7), name, "replace", path=path)
    with pytest.raises(Exception, match="broken"):
        publish_table(_failing(spark), name, "replace", path=path)
    assert spark.table(name).count() == 7
    publish_table(spark.range(3).selectExpr("id", "'x' AS more"), name, "replace", path=path)
    assert (spark.table(name).count(), spark.table(name).columns) == (3, ["id", "more"])


@pytest.mark.parametrize("table", [None, "spark_catalog.guards.resumed"])
def test_a_resumed_append_does_not_double(spark, kept, tmp_path, monkeypatch, table):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS spark_catalog.guards")
    ledger, out = RunLedger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    arguments = {"mode": "append", "table": table, "ledger": ledger, "run_id": "r1"}
    record_all = ledger.record_all

    def fails_later(run_id, rows):
        if any(row["state"] in ("WRITTEN", "COMPLETED") for row in rows):
            raise OSError("ledger is away")
        record_all(run_id, rows)

    monkeypatch.setattr(ledger, "record_all", fails_later)
    with pytest.raises(OSError):
        run_transform(spark, "SELECT * FROM source_data", [kept], out, **arguments)
    monkeypatch.setattr(ledger, "record_all", record_all)
    result = run_transform(spark, "SELECT * FROM source_data", [kept], out, **arguments)
    assert (result.rows_out, spark.read.parquet(out).count()) == (10, 10)
    run_transform(spark, "SELECT * FROM source_data", [kept], out, mode="append")
    assert spark.read.parquet(out).count() == 20


def test_jsonl_keeps_every_value(spark, tmp_path):
    rows = spark.sql(
        """SELECT id, CAST(NULL AS STRING) AS nothing, timestamp_micros(1700000000123456 + id) AS t,
           CAST(timestamp_micros(1700000000000001 + id) AS TIMESTAMP_NTZ) AS n FROM range(20)"""
    )
    path = str(tmp_path / "landing")
    ingest(rows, path, "r1", metadata=False)
    back = scan(spark, path, "json", rows.schema, mode="FAILFAST")
    assert back.exceptAll(rows).isEmpty() and back.count() == 20
    assert "nothing" in spark.read.json(path).columns


def test_batch_and_stream_do_not_share_a_folder(spark, kept, tmp_path):
    stream = stream_files(spark, kept, spark.range(1).schema)
    with pytest.raises(ValueError, match="refusing to stream"):
        ingest_stream(stream, kept, str(tmp_path / "c0"))
    out = str(tmp_path / "streamed")
    ingest_stream(stream, out, str(tmp_path / "c1")).awaitTermination()
    with pytest.raises(ValueError, match="a stream writes there"):
        write_files(spark.range(7), out, "append")
    assert spark.read.parquet(out).count() == 10


def test_late_rows_are_kept(spark, tmp_path):
    start = datetime(2024, 5, 1)
    rows = lambda ids, days: spark.createDataFrame(
        [(i, start + timedelta(days=days)) for i in ids] + [(None, None)], "id bigint, ts timestamp"
    )
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for frame in (rows([1, 2, 2], 10), rows([3, 3], 0), rows([2], 10), rows([], 0)):
        frame.write.mode("append").parquet(source)
        merge_stream(stream_files(spark, source, frame.schema), out, str(tmp_path / "c"), ["id"], "ts", grain="day").awaitTermination()
    found = [r.id for r in merged_rows(spark, out, rows([], 0).schema).collect()]
    assert sorted(found, key=str) == [1, 2, 3, None]


def test_one_opening_and_reader_options(spark, tmp_path):
    write_files(spark.range(3), str(tmp_path / "a"))
    write_files(spark.range(3).withColumn("b", F.lit(1)), str(tmp_path / "a"), "append")
    frame, _ = scan_all(spark, [str(tmp_path / "a")], mergeSchema="true")
    assert set(frame.columns) == {"id", "b"} and frame.count() == 6
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"a": 1}\n')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("openings", "openings")
    try:
        run_transform(spark, "SELECT * FROM source_data", [str(tmp_path / "j")], str(tmp_path / "o1"), scan_options={"format": "json"})
        inferred = len(tracker.getJobIdsForGroup("openings"))
        spark.sparkContext.setJobGroup("declared", "declared")
        run_transform(spark, "SELECT a FROM source_data", [str(tmp_path / "j")], str(tmp_path / "o2"), scan_options={"format": "json", "schema": "a BIGINT"})
        declared = len(tracker.getJobIdsForGroup("declared"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert inferred == declared + 1


def test_job_reports_and_ledger_tells_the_truth(spark, kept, tmp_path):
    root = str(tmp_path / "ledger")
    env = {
        "SQL_QUERY": "SELECT id FROM source_data WHERE id >= :low",
        "SOURCE_PATHS": json.dumps([kept, str(tmp_path / "missing")]),
        "DESTINATION_PATH": str(tmp_path / "out"),
    }
    settings = {"params": '{"low": 4}', "ledger": root, "name": "sync", "preview": "2", "options": "{}"}
    for key, value in settings.items():
        spark.conf.set(f"spark.sql.transform.{key}", value)
    try:
        lines = report(spark, run_job(spark, env))
        spark.conf.set("spark.sql.transform.params", "[1]")
        with pytest.raises(ValueError, match="params"):
            job_arguments(spark, env)
    finally:
        for key in settings:
            spark.conf.unset(f"spark.sql.transform.{key}")
    text = "\n".join(lines)
    assert "missing: unreadable" in text and f"rows in {kept}: 10" in text and "6 rows" in text and "column id: bigint" in text
    assert sum(line.startswith("{'id'") for line in lines) == 2
    ledger = RunLedger(spark, root)
    ingest(spark.range(4), str(tmp_path / "landing"), "r2", ledger=ledger, name="landing", schedule_type="basic", interval_seconds=60)
    status = {r["name"]: r for r in ingest_status(ledger.runs()).collect()}
    assert status["sync"]["status"] == status["landing"]["status"] == "COMPLETED"
    assert status["landing"]["next_sync"] - status["landing"]["last_sync"] == timedelta(seconds=60)
    row = ledger.runs().filter("name = 'sync'").head()
    assert (row["driver_cores"], row["executor_instances"]) == (spark.sparkContext.defaultParallelism, 0)
    assert (row["spark_version"], row["application_id"]) == (spark.version, spark.sparkContext.applicationId)
    assert job_resource_usage(ledger.runs()).head()["runs"] == 2
    assert ledger.events().filter("reason = 'SourceLeftOut'").count() == 1


def test_bounds(spark):
    config = PostgresConfig(host="h", port=5432, database="d", username="u", password="p")
    with pytest.raises(ValueError, match="single task"):
        scan_jdbc(spark, config, "t")
    runs = spark.sql(
        """SELECT CAST(id AS STRING) AS run_id, 'COMPLETED' AS state, timestamp_seconds(1700000000 + 7 * id) AS submitted_at,
           timestamp_seconds(1700000050 + 7 * id) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at,
           timestamp_seconds(1700000050 + 7 * id) AS recorded_at FROM range(20000)"""
    )
    fine = job_queue_depth(runs, "second")
    whole = fine.agg(F.max("peak_depth").alias("p")).head()["p"]
    assert whole == 8 and fine.orderBy(F.desc("period")).head()["end_depth"] == 0


def test_union_by_name_checks_types(spark):
    number, text = spark.sql("SELECT 1L AS a, 2 AS b"), spark.sql("SELECT 'x' AS a")
    with pytest.raises(ValueError, match="column a is string, expected bigint"):
        combine([number, text], by="name")
    with pytest.raises(ValueError, match="source 3"):
        combine([spark.sql("SELECT 2 AS b"), text, number], by="name")
    assert combine([number, spark.sql("SELECT 3L AS a")], by="name").count() == 2


def test_names_with_dots_and_helper_names(spark):
    frame = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "`a.b` int, _dedup_rank int, _mark0 int")
    kept = dedup_latest(frame, ["a.b"], ["_dedup_rank"])
    assert kept.columns == frame.columns and kept.count() == 1
    rules = [Unique("u", ("a.b",)), NotNull("n", "a.b"), InRange("r", "a.b", 0, 3)]
    flagged = flag_quality(frame, rules)
    assert flagged.columns == [*frame.columns, "_failed_rules"]
    assert [r["_failed_rules"] for r in flagged.collect()] == [["u"], ["u"]]


def test_sums_and_whole_numbers_do_not_lose_fractions(spark):
    cents = spark.sql("SELECT explode(array(0.1D, 0.25D, 1234567.89D, NULL)) AS v")
    assert cents.agg(exact_sum("v")).head()[0] == 1234568.24
    with pytest.raises(Exception, match="more than 2 decimals"):
        spark.sql("SELECT 0.004D AS v").agg(exact_sum("v")).collect()
    mixed = spark.sql("SELECT 3.7D AS a, 3.0D AS b, '4.5' AS c, '4' AS d, 2.5 AS e")
    assert tuple(standardize(mixed, "a INT, b INT, c BIGINT, d BIGINT, e INT").head()) == (None, 3, None, 4, None)


def test_one_write_for_both_outcomes(spark, tmp_path):
    frame = spark.range(10).selectExpr("id", "id % 3 AS _passed")
    good, bad = write_quality(frame, [InRange("low", "id", 0, 6)], str(tmp_path / "split"))
    assert good.columns == frame.columns and good.count() == 7
    assert bad.columns == [*frame.columns, "_failed_rules"] and {tuple(r["_failed_rules"]) for r in bad.collect()} == {("low",)}
