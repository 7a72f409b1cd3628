"""Batch ingestion into the bronze layer."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators.sinks import write_files
from tierflow.plans.ledger import RunLedger
from tierflow.plans.transform import Resources

LOAD_COLUMNS = ("_source_file", "_run_id", "_ingested_at")


def with_load_metadata(frame: DataFrame, run_id: str) -> DataFrame:
    """Rows unchanged, plus the file they came from (NULL for other sources), run and load time."""
    return frame.select(
        "*",
        F.nullif(F.input_file_name(), F.lit("")).alias("_source_file"),
        F.lit(run_id).alias("_run_id"),
        F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("_ingested_at"),
    )


def land_bronze(frame: DataFrame, path: str, run_id: str, format: str = "parquet") -> int:
    """Append raw rows to the archive; returns how many."""
    return write_files(with_load_metadata(frame, run_id), path, "append", format=format)


def ingest(
    frame: DataFrame,
    path: str,
    run_id: str,
    *,
    format: str = "json",
    mode: str = "append",
    metadata: bool = True,
    ledger: RunLedger | None = None,
    name: str | None = None,
    schedule_type: str = "manual",
    interval_seconds: int | None = None,
) -> int:
    """Move a source relation (file, JDBC, Kafka, document store) to a bronze sink.

    The sink format is JSONL unless Parquet is asked for. The run is recorded under ``name``, by
    default the sink's path, with its schedule, for ``ingest_status``.
    """
    started = datetime.now(timezone.utc)
    known = {
        "destination": path,
        "submitted_at": started,
        "started_at": started,
        "name": name or path,
        "schedule_type": schedule_type,
        "interval_seconds": interval_seconds,
        "spark_version": frame.sparkSession.version,
        "application_id": frame.sparkSession.sparkContext.applicationId,
        **asdict(Resources.of(frame.sparkSession)),
    }
    if ledger:
        ledger.record(run_id, "RUNNING", **known)
    try:
        loaded = with_load_metadata(frame, run_id) if metadata else frame
        rows = write_files(loaded, path, mode, format=format)
    except Exception as error:
        if ledger:
            ended = {"error_message": str(error), "finished_at": datetime.now(timezone.utc)}
            ledger.record(run_id, "FAILED", **known, **ended)
        raise
    if ledger:
        ended = {"rows_out": rows, "finished_at": datetime.now(timezone.utc)}
        ledger.record(run_id, "COMPLETED", **known, **ended)
    return rows
