"""Streaming ingestion into the bronze layer, and deduplication on the way to silver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tierflow.functions.naming import quoted
from tierflow.operators.changes import holds_files
from tierflow.operators.sinks import LOSSLESS_JSON, path_exists

PERIOD = "_period"


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Stream over a folder or over one file.

    The path is given as a glob that matches only itself: Spark takes a plain path for a base folder
    and refuses a single file there.
    """
    glob = path.rstrip("/")
    glob = f"{glob[:-1]}[{glob[-1]}]"
    return spark.readStream.schema(schema).format(format).options(**options).load(glob)


def ingest_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    schedule: str = "manual",
    interval: str | None = None,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Append a stream to files exactly once. Readers of the folder then see the stream's own files
    only, so a folder that holds other files is refused.

    ``schedule="manual"`` reads what is there and stops; ``"basic"`` repeats at ``interval``. The
    checkpoint holds progress and state, so a restarted query writes no row twice.
    """
    if path_exists(stream.sparkSession, path) and not path_exists(stream.sparkSession, f"{path}/_spark_metadata"):
        raise ValueError(f"refusing to stream into {path}: it holds files that a stream's readers would not see")
    writer = (
        stream.writeStream.format(format)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if format == "json":
        writer = writer.options(**LOSSLESS_JSON)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _scheduled(writer, schedule, interval).start()


def _scheduled(writer, schedule: str, interval: str | None):
    if schedule == "manual":
        return writer.trigger(availableNow=True)
    if schedule == "basic" and interval:
        return writer.trigger(processingTime=interval)
    raise ValueError("schedule must be manual, or basic with an interval")


def merge_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    ts: str,
    *,
    grain: str = "month",
    schedule: str = "manual",
    interval: str | None = None,
) -> StreamingQuery:
    """Append the rows of a stream whose key the silver folder does not hold yet; no row is too late.

    Each batch is cut to one row per key and anti-joined with the keys of the periods it touches, read
    from ``path``, which is partitioned by ``_period`` (``ts`` cut to ``grain``) so that a batch reads
    only those. Copies of a row carry its time: the same key in another period is another row. A batch
    that runs again after a failure finds its own rows and adds none. NULL keys and times count as
    values. Read the folder with ``merged_rows``.
    """

    def merge(batch: DataFrame, _: int) -> None:
        period = F.coalesce(F.date_format(F.date_trunc(grain, quoted(ts)), "yyyy-MM-dd-HH"), F.lit("none"))
        rows = batch.withColumn(PERIOD, period).dropDuplicates([*keys, PERIOD]).persist()
        try:
            # Not the marker of a finished job, which object-store committers often leave out.
            if holds_files(batch.sparkSession, path):
                there = batch.sparkSession.read.schema(rows.schema).parquet(path)
                # One short text per period of the batch.
                touched = [r[0] for r in rows.select(PERIOD).distinct().collect()]
                known = there.filter(F.col(PERIOD).isin(touched)).select(
                    *[quoted(k).alias(f"_known{i}") for i, k in enumerate([*keys, PERIOD])]
                )
                same = [quoted(k).eqNullSafe(F.col(f"_known{i}")) for i, k in enumerate([*keys, PERIOD])]
                rows_new = rows.join(known, same, "left_anti")
            else:
                rows_new = rows
            rows_new.write.mode("append").partitionBy(PERIOD).parquet(path)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _scheduled(writer, schedule, interval).start()


def merged_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a ``merge_stream`` folder, in the schema of its stream."""
    whole = StructType([*schema.fields]).add(PERIOD, "string")
    return spark.read.schema(whole).parquet(path).drop(PERIOD)


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row of each key among rows that arrive within ``delay`` of each other.

    State is dropped once the watermark has passed, so a copy that comes later than that may get
    through, and Spark leaves out a row older than the watermark, duplicate or not. That suits sources
    with a known lag; where rows may come later than any delay, use ``merge_stream``. The time column
    comes back as TIMESTAMP, since watermarks take no other type.
    """
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark(list(keys))
    )
