"""The transform job, for ``spark-submit``.

Arguments come from the session settings ``spark.sql.transform.{query,sources,destination,
writeMode}`` or, where those are unset, from the environment variables ``SQL_QUERY``,
``SOURCE_PATHS``, ``DESTINATION_PATH`` and ``WRITE_MODE``. Sources are a JSON list of paths.
Optional settings: ``spark.sql.transform.{format,catalog,table,tableMode,ledger,runId,name}``;
``params`` (SQL parameters) and ``options`` (reader options, ``schema`` among them), each a JSON
object; ``countInputs`` (``false`` to leave the counts out) and ``preview`` (rows to show, 10).
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping

from pyspark import SparkConf
from pyspark.sql import SparkSession

from tierflow.operators import preview
from tierflow.plans import RunLedger, RunResult, run_transform
from tierflow.session import build_session, object_store_conf

# Setting and environment names of the job's parameters.
PARAMETERS = {
    "query": "SQL_QUERY",
    "sources": "SOURCE_PATHS",
    "destination": "DESTINATION_PATH",
    "writeMode": "WRITE_MODE",
}


def job_arguments(spark: SparkSession, env: Mapping[str, str]) -> dict:
    """Checked job arguments; raises ``ValueError`` before any Spark job starts."""

    def setting(name: str) -> str | None:
        value = spark.conf.get(f"spark.sql.transform.{name}", None)
        return value or env.get(PARAMETERS.get(name, ""))

    required = {name: setting(name) for name in ("query", "sources", "destination")}
    for name, value in required.items():
        if not value:
            raise ValueError(f"spark.sql.transform.{name} or {PARAMETERS[name]} is required")
    try:
        sources = json.loads(required["sources"])
    except json.JSONDecodeError as error:
        raise ValueError(f"sources are not valid JSON: {error}") from error
    params, options = (_object(setting(name), name) for name in ("params", "options"))
    ledger = setting("ledger")
    return {
        "sql": required["query"],
        "sources": sources,
        "destination": required["destination"],
        "mode": setting("writeMode") or "overwrite",
        "params": params,
        "scan_options": {"format": setting("format") or "parquet", **options},
        "count_inputs": (setting("countInputs") or "true").lower() != "false",
        "name": setting("name"),
        "catalog": setting("catalog"),
        "table": setting("table"),
        "table_mode": setting("tableMode") or "append",
        "run_id": setting("runId"),
        "ledger": RunLedger(spark, ledger) if ledger else None,
    }


def _object(text: str | None, name: str) -> dict:
    value = json.loads(text) if text else {}
    if not isinstance(value, dict):
        raise ValueError(f"{name} must be a JSON object")
    return value


def report(spark: SparkSession, result: RunResult) -> list[str]:
    """What the job tells its caller: each source, counts, schema and a few rows of what was written."""
    lines = [f"source {s.path}: {s.status} {s.detail}".rstrip() for s in result.sources]
    lines += [f"rows in {source}: {n}" for source, n in result.rows_in.items()]
    lines.append(f"run {result.run_id}: {result.rows_out} rows in {result.destination}")
    written = spark.read.parquet(result.destination)
    lines += [f"column {f.name}: {f.dataType.simpleString()}" for f in written.schema.fields]
    shown = int(spark.conf.get("spark.sql.transform.preview", "10"))
    lines += [str(row.asDict(recursive=True)) for row in preview(written, shown).collect()] if shown else []
    return [*lines, *(f"warning: {w}" for w in result.warnings)]


def run_job(spark: SparkSession, env: Mapping[str, str]) -> RunResult:
    return run_transform(spark, **job_arguments(spark, env))


def main() -> int:
    # Only what the environment names is passed on; otherwise the cluster's own settings stay in force.
    named = ("AWS_ACCESS_KEY_ID", "AWS_REGION", "S3_ENDPOINT")
    known = dict(SparkConf().getAll())
    store = object_store_conf(os.environ, known) if any(os.environ.get(n) for n in named) else {}
    spark = build_session("tierflow transform", conf=store)
    try:
        for line in report(spark, run_job(spark, os.environ)):
            print(line)
    except Exception as error:  # the exit status is the job's answer to its caller
        print(f"transform failed: {error}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
