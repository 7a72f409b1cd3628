from datetime import datetime, timedelta

import pytest

from tierflow.streaming import dedup_stream, ingest_stream, stream_files

SCHEMA = "id bigint, ts timestamp_ntz, v string"
START = datetime(2024, 1, 1)


def _add(spark, folder, rows):
    frame = spark.createDataFrame([(i, START + timedelta(minutes=m), v) for i, m, v in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return stream_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)


def test_restart_reads_only_new_files(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    _add(spark, source, [(1, 0, "a"), (2, 1, "b")])
    ingest_stream(_stream(spark, source), out, progress).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    _add(spark, source, [(3, 2, "c")])
    for _ in range(2):
        ingest_stream(_stream(spark, source), out, progress).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_duplicates_are_dropped_within_and_across_restarts(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        unique = dedup_stream(_stream(spark, source), ["id"], "ts", "2 hours")
        ingest_stream(unique, out, progress).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    _add(spark, source, [(1, 0, "a"), (1, 0, "a"), (2, 10, "b")])
    assert run() == [1, 2]
    _add(spark, source, [(2, 12, "b"), (3, 20, "c")])
    assert run() == [1, 2, 3]
    assert dict(spark.read.parquet(out).dtypes)["ts"] == "timestamp"


def test_one_file_can_be_streamed(spark, small_dir, tmp_path):
    path = f"{small_dir}/events.parquet"
    stream = stream_files(spark, path, spark.read.parquet(path).schema)
    out = str(tmp_path / "out")
    ingest_stream(stream, out, str(tmp_path / "p"), partition_by=["event_type"]).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(path).count()


def test_interval_schedule_keeps_running(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _add(spark, source, [(1, 0, "a")])
    query = ingest_stream(
        _stream(spark, source), out, str(tmp_path / "p"), schedule="basic", interval="1 second"
    )
    try:
        query.processAllAvailable()
        _add(spark, source, [(2, 0, "b")])
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(out).count() == 2
    finally:
        query.stop()
    with pytest.raises(ValueError):
        ingest_stream(_stream(spark, source), out, str(tmp_path / "p2"), schedule="basic")
