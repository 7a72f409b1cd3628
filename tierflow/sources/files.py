"""File sources: one path, or many paths read into one relation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from tierflow.operators.combine import combine, mismatch

CORRUPT_COLUMN = "_corrupt_record"


@dataclass(frozen=True)
class SourceReport:
    """What became of one source: ``read``, ``unreadable``, ``empty`` or ``mismatched``."""

    path: str
    status: str
    detail: str = ""


def scan(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: StructType | str | None = None,
    mode: str = "PERMISSIVE",
    **options: str,
) -> DataFrame:
    """Lazy scan of one path.

    Parquet takes its schema from a footer. Give JSONL a schema whenever one is known: without it
    Spark reads the whole input once just to infer the columns. In permissive mode a line that does
    not parse is kept, whole, in ``_corrupt_record``.
    """
    reader = spark.read.options(**options)
    if schema is not None:
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if format == "json" and mode == "PERMISSIVE" and CORRUPT_COLUMN not in schema.fieldNames():
            schema = StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())])
        reader = reader.schema(schema)
    if format == "json":
        reader = reader.option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    return reader.format(format).load(path)


def load_sources(
    spark: SparkSession,
    paths: Sequence[str],
    *,
    on_error: str = "skip",
    skip_empty: bool = False,
    format: str = "parquet",
    schema: StructType | str | None = None,
    **options: str,
) -> tuple[list[tuple[str, DataFrame]], list[SourceReport]]:
    """Open every path once; with ``on_error="skip"`` an unreadable one is reported and left out.

    ``skip_empty`` asks for one row only, so it never counts a source. ``options`` go to the reader,
    such as ``mergeSchema="true"`` for Parquet files that differ in columns.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError(f"on_error must be skip or fail, got {on_error!r}")
    opened: list[tuple[str, DataFrame]] = []
    reports: list[SourceReport] = []
    for path in paths:
        try:
            frame = scan(spark, path, format, schema, **options)
            empty = skip_empty and frame.isEmpty()
        except (PySparkException, Py4JJavaError) as error:
            if on_error == "fail":
                raise
            reports.append(SourceReport(path, "unreadable", _first_line(error)))
            continue
        if empty:
            reports.append(SourceReport(path, "empty"))
            continue
        opened.append((path, frame))
        reports.append(SourceReport(path, "read"))
    return opened, reports


def scan_all(
    spark: SparkSession,
    paths: Sequence[str],
    *,
    on_error: str = "skip",
    skip_empty: bool = False,
    by: str = "position",
    on_mismatch: str = "fail",
    strict: bool = True,
    format: str = "parquet",
    schema: StructType | str | None = None,
    **options: str,
) -> tuple[DataFrame, list[SourceReport]]:
    """All readable sources as one relation, with a report per source.

    Fails only when nothing can be read. A source that does not fit the first one fails the scan,
    or is reported as ``mismatched`` and left out with ``on_mismatch="skip"``.
    """
    opened, reports = load_sources(
        spark, paths, on_error=on_error, skip_empty=skip_empty, format=format, schema=schema, **options
    )
    return combine_sources(opened, reports, by=by, on_mismatch=on_mismatch, strict=strict)[::2]


def combine_sources(
    opened: list[tuple[str, DataFrame]],
    reports: list[SourceReport],
    *,
    by: str = "position",
    on_mismatch: str = "fail",
    strict: bool = True,
) -> tuple[DataFrame, list[tuple[str, DataFrame]], list[SourceReport]]:
    """Opened sources as one relation, the sources it is made of, and the reports."""
    if not opened:
        found = "; ".join(f"{r.path}: {r.status}" for r in reports)
        raise ValueError(f"no data could be read from any source ({found})")
    if on_mismatch == "skip":
        first = opened[0][1]
        problems = {path: mismatch(first, frame, strict, by) for path, frame in opened}
        reports = [
            SourceReport(r.path, "mismatched", problems[r.path])
            if r.status == "read" and problems[r.path]
            else r
            for r in reports
        ]
        opened = [(path, frame) for path, frame in opened if not problems[path]]
    return combine([frame for _, frame in opened], by=by, strict=strict), opened, reports


def _first_line(error: Exception) -> str:
    return next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)
