"""SQL transformation: register sources, run a SQL text, write and publish the result."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tierflow.functions.naming import layer_path, normalize_path, split_table_name, target_table
from tierflow.operators.combine import SOURCE_VIEW, register
from tierflow.operators.profile import row_counts
from tierflow.operators.sinks import RUN, overlaps, path_exists, run_rows, write_files, write_run
from tierflow.operators.tables import ensure_namespace, publish_table
from tierflow.plans.history import latest_runs
from tierflow.plans.ledger import RunLedger
from tierflow.session import check_catalog, workspace
from tierflow.sources.files import SourceReport, combine_sources, load_sources, scan

# Hidden from readers of the destination by its underscore.
APPENDED = "_appended"

Sources = DataFrame | str | Sequence[str] | Mapping[str, DataFrame | str]

# One token: a quoted text, a comment (or where one begins), a separator, or anything else.
_TOKEN = re.compile(
    r"""\b[rR]'[^']*'|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`|--[^\n]*|/\*|;|.""", re.DOTALL
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")


def split_script(text: str) -> list[str]:
    """Statements of a script: cut at semicolons outside quotes and comments, empty ones dropped.

    Compound ``BEGIN … END`` blocks are not statements of a script; Spark would return their result
    through the driver.
    """
    statements, start, code, at = [], 0, False, 0
    while match := _TOKEN.match(text, at):
        token, at = match.group(), match.end()
        if token == "/*":
            at = _comment_end(text, at)
        elif token == ";":
            if code:
                statements.append(text[start : at - 1].strip())
            start, code = at, False
        elif token.strip() and not token.startswith("--"):
            code = True
    if code:
        statements.append(text[start:].strip())
    return statements


def _comment_end(text: str, at: int) -> int:
    depth = 1
    while depth:
        edge = _COMMENT_EDGE.search(text, at)
        if edge is None:
            return len(text)
        depth += 1 if edge.group() == "/*" else -1
        at = edge.end()
    return at


def transform_sql(
    spark: SparkSession,
    sources: Sources,
    sql: str | Sequence[str],
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """Run SQL over registered sources; the last statement is the result and stays lazy.

    A single relation, path or list of paths becomes the view ``source_data``; a mapping registers
    one view per name. ``params`` are bound by Spark as ``:name`` markers and are never pasted into
    the text.
    """
    statements = _statements(sql)
    if not isinstance(sources, DataFrame) and not sources:
        raise ValueError("sources are required")
    _register_sources(spark, sources)
    return _run_statements(spark, statements, params)


def _statements(sql: str | Sequence[str]) -> list[str]:
    statements = split_script(sql) if isinstance(sql, str) else list(sql)
    if not statements:
        raise ValueError("a SQL query is required")
    return statements


def _run_statements(
    spark: SparkSession, statements: Sequence[str], params: Mapping[str, object] | None
) -> DataFrame:
    *before, last = statements
    args = dict(params) if params else None
    for statement in before:
        spark.sql(statement, args=args)
    return spark.sql(last, args=args)


def _register_sources(
    spark: SparkSession, sources: Sources, options: Mapping[str, object] | None = None
) -> tuple[dict[str, DataFrame], list[SourceReport]]:
    """Register the views; returns the single relations behind them, and a report per path."""
    options = dict(options or {})
    if isinstance(sources, Mapping):
        opened = {
            name: source if isinstance(source, DataFrame) else scan(spark, source, **options)
            for name, source in sources.items()
        }
        for name, frame in opened.items():
            register(frame, name)
        return opened, []
    if isinstance(sources, DataFrame):
        register(sources, SOURCE_VIEW)
        return {SOURCE_VIEW: sources}, []
    paths = [sources] if isinstance(sources, str) else list(sources)
    union = {key: options.pop(key) for key in ("by", "on_mismatch", "strict") if key in options}
    combined, opened, reports = combine_sources(*load_sources(spark, paths, **options), **union)
    register(combined, SOURCE_VIEW)
    return dict(opened), reports


@dataclass(frozen=True)
class Resources:
    """Resource request of a run, kept in the ledger."""

    executor_instances: int = 1
    executor_cores: int = 1
    executor_memory: str = "512m"
    driver_cores: int = 1
    driver_memory: str = "512m"

    @classmethod
    def of(cls, spark: SparkSession) -> Resources:
        """What the session runs with. In local mode the driver's cores do all the work."""
        context = spark.sparkContext
        get = context.getConf().get
        local = context.master.startswith("local") and not context.master.startswith("local-cluster")
        memory = get("spark.driver.memory", "1g")
        if local:
            return cls(0, 0, "0", context.defaultParallelism, memory)
        cores = int(get("spark.executor.cores", "1"))
        given = get("spark.executor.instances", None) or get("spark.dynamicAllocation.maxExecutors", None)
        # Without a number in the settings, as many as offer the session's parallelism.
        count = int(given) if given else max(1, context.defaultParallelism // cores)
        return cls(count, cores, get("spark.executor.memory", "1g"), int(get("spark.driver.cores", "1")), memory)


@dataclass(frozen=True)
class RunResult:
    run_id: str
    state: str
    rows_out: int | None
    destination: str
    table: str | None
    rows_in: dict[str, int] = field(default_factory=dict)
    sources: list[SourceReport] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def new_run_id() -> str:
    return uuid.uuid4().hex


def run_transform(
    spark: SparkSession,
    sql: str | Sequence[str],
    sources: Sources,
    destination: str,
    *,
    mode: str = "overwrite",
    params: Mapping[str, object] | None = None,
    scan_options: Mapping[str, object] | None = None,
    count_inputs: bool = False,
    files: int | None = None,
    catalog: str | None = None,
    table: str | None = None,
    table_mode: str = "append",
    table_path: str | None = None,
    ledger: RunLedger | None = None,
    run_id: str | None = None,
    resources: Resources | None = None,
    name: str | None = None,
    schedule_type: str = "manual",
    interval_seconds: int | None = None,
    by_run: bool = False,
    table_partition_by: Sequence[str] = (),
) -> RunResult:
    """Transform, write files, then publish a table from the written files.

    The result is computed once: its rows are counted by the write. Files come first and the table
    after them, so a failed publish leaves whole files behind and the ledger at ``WRITTEN``; calling
    again with the same ``run_id`` and ledger goes straight to the publish. A crash between the
    publish and the ledger entry can make that second publish append twice.

    An append to files leaves a hidden mark of its run in the destination as soon as it is done, so
    calling again with the same ``run_id`` does not append again, whatever became of the ledger. Only
    a crash between the append and its mark, two steps without work between them, can double it.

    With ``by_run`` an append has no such gap: the rows of a run are a partition ``_run`` of their own in the
    destination and in the table, and writing or publishing them again replaces that partition. Cut off
    anywhere and called again with its ``run_id``, a run leaves each row once. The rows get that column; a
    destination or table that was not laid out so is refused.

    ``table_partition_by`` lays out a table that the publish creates.

    Sources that were left out are recorded as events of the run. ``resources`` are those of the
    session unless given; ``name``, ``schedule_type`` and ``interval_seconds`` describe the job that
    the run belongs to (see ``ingest_status``).

    The table gets the name ``table``, or one derived from ``destination`` when only ``catalog`` is
    given. With ``mode="append"`` it receives the rows of this run alone, not what the destination
    held before.

    ``scan_options`` go to ``scan_all`` (``format``, ``skip_empty``, ``by``, …), or to ``scan`` for
    named sources. ``count_inputs`` adds the row count of each source, from a pass that reads no
    column data.
    """
    statements = _statements(sql)
    if not isinstance(sources, DataFrame) and not sources:
        raise ValueError("sources are required")
    if not destination:
        raise ValueError("a destination is required")
    sources, destination = _normalized(sources), normalize_path(destination)
    target = table or (target_table(destination, catalog) if catalog else None)
    if target:
        check_catalog(spark, split_table_name(target)[0])
    paths = _paths(sources)
    _refuse_overwrite(mode, destination, paths, statements)
    if by_run and mode != "append":
        raise ValueError("by_run is a way to append")

    last = _last_row(ledger, run_id) if ledger and run_id else None
    resumed = last is not None and last["state"] == "WRITTEN"
    run_id = run_id or new_run_id()
    staged = target is not None and mode == "append" and not by_run
    # Known from the run id alone, so that a resumed run finds it again.
    written_to = f"{workspace(spark)}/tierflow/runs/{run_id}" if staged else destination
    job = {"name": name or destination, "schedule_type": schedule_type, "interval_seconds": interval_seconds}
    run = _LedgerRow(ledger, run_id, statements, paths, destination, resources or Resources.of(spark), job)
    mark = f"{destination}/{APPENDED}/{run_id}"
    if resumed:
        run.resume(last)

    rows: int | None = last["rows_out"] if resumed else None
    reports: list[SourceReport] = []
    rows_in: dict[str, int] = {}
    warnings: list[str] = []
    try:
        if not resumed:
            run.note("SUBMITTED")
            run.record("RUNNING", started_at=datetime.now(timezone.utc))
            opened, reports = _register_sources(spark, sources, scan_options)
            run.left_out(reports)
            if count_inputs:
                rows_in = {r["source"]: r["row_count"] for r in row_counts(opened).collect()}
            done = _appended_rows(spark, mark) if mode == "append" and not by_run else None
            if by_run:
                rows = write_run(_run_statements(spark, statements, params), destination, run_id)
            elif done is None:
                result = _run_statements(spark, statements, params)
                rows = write_files(
                    result, written_to, "overwrite" if staged else mode, files=files, reads=paths
                )
                if staged:
                    write_files(spark.read.parquet(written_to), destination, "append", files=files)
                if mode == "append":
                    _mark_appended(spark, mark, rows)
            else:
                rows = done
            run.note("WRITTEN", rows_out=rows)
        if target:
            run.save()
            catalog_name, namespace, _ = split_table_name(target)
            warning = ensure_namespace(spark, catalog_name, namespace)
            warnings += [warning] if warning else []
            written, layout = spark.read.parquet(written_to), list(table_partition_by)
            if by_run:
                written = run_rows(spark, destination, run_id)
                layout, table_mode = [RUN, *layout], "overwrite" if table_mode == "append" else table_mode
            publish_table(written, target, table_mode, partition_by=layout, path=table_path)
            run.note("PUBLISHED")
    except Exception as error:
        run.fail(error)
        raise
    run.record("COMPLETED", finished_at=datetime.now(timezone.utc))
    return RunResult(run_id, "COMPLETED", rows, destination, target, rows_in, reports, warnings)


def _appended_rows(spark: SparkSession, mark: str) -> int | None:
    """Rows that this run has already appended, or None."""
    if not path_exists(spark, mark):
        return None
    return int(spark.read.text(f"{mark}/rows").head()[0])


def _mark_appended(spark: SparkSession, mark: str, rows: int) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{mark}/rows")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(str(rows).encode()))
    finally:
        stream.close()


def run_layer_transform(
    spark: SparkSession,
    sql: str | Sequence[str],
    root: str,
    source_path: str | None = None,
    **options: object,
) -> RunResult:
    """Transform from the bronze layer of a bucket or folder, or from ``source_path``, into a folder
    of the run's own in the silver layer."""
    run_id = options.pop("run_id", None) or new_run_id()
    source = source_path or layer_path(root, "bronze")
    destination = layer_path(root, "silver", run_id)
    return run_transform(spark, sql, [source], destination, run_id=run_id, **options)


def _normalized(sources: Sources) -> Sources:
    def one(source):
        return normalize_path(source) if isinstance(source, str) else source

    if isinstance(sources, Mapping):
        return {name: one(source) for name, source in sources.items()}
    if isinstance(sources, (DataFrame, str)):
        return one(sources)
    return [one(source) for source in sources]


def _paths(sources: Sources) -> list[str]:
    if isinstance(sources, DataFrame):
        return []
    if isinstance(sources, str):
        return [sources]
    values = sources.values() if isinstance(sources, Mapping) else sources
    return [value for value in values if isinstance(value, str)]


def _refuse_overwrite(
    mode: str, destination: str, paths: list[str], statements: Sequence[str]
) -> None:
    if mode != "overwrite":
        return
    path = re.compile(re.escape(destination.rstrip("/")) + r"(?![\w.-])")
    named = any(path.search(statement) for statement in statements)
    if named or overlaps(destination, paths):
        raise ValueError(f"refusing to overwrite {destination}: the query reads it")


def _last_row(ledger: RunLedger, run_id: str) -> dict | None:
    found = latest_runs(ledger.runs(run_id)).head(1)
    return found[0].asDict() if found else None


class _LedgerRow:
    """What is known about a run so far. Each state change is a whole new row of the ledger; changes
    that follow each other at once are noted first and saved together."""

    def __init__(self, ledger, run_id, statements, paths, destination, resources, job) -> None:
        self.ledger, self.run_id, self.state = ledger, run_id, None
        self.pending: list[dict] = []
        self.known = {
            "sql": ";\n".join(statements),
            "source": ",".join(paths),
            "destination": destination,
            "submitted_at": datetime.now(timezone.utc),
            "submission_attempts": 1,
            "execution_attempts": 1,
            **asdict(resources),
            **job,
        }
        if ledger is not None:
            self.known["spark_version"] = ledger.spark.version
            self.known["application_id"] = ledger.spark.sparkContext.applicationId

    def left_out(self, reports: Sequence[SourceReport]) -> None:
        for report in reports if self.ledger is not None else []:
            if report.status != "read":
                message = f"{report.path}: {report.status} {report.detail}".strip()
                self.ledger.event(self.run_id, "SourceLeftOut", message)

    def resume(self, last: dict) -> None:
        self.state = last["state"]
        given = ("run_id", "spark_application", "state", "recorded_at")
        self.known = {name: value for name, value in last.items() if name not in given}
        self.known["execution_attempts"] = (last["execution_attempts"] or 0) + 1

    def note(self, state: str, **fields: object) -> None:
        self.state = state
        self.known |= fields
        now = datetime.now(timezone.utc)
        self.pending.append({**self.known, "state": state, "recorded_at": now})

    def save(self) -> None:
        if self.ledger is not None and self.pending:
            self.ledger.record_all(self.run_id, self.pending)
        self.pending = []

    def record(self, state: str, **fields: object) -> None:
        self.note(state, **fields)
        self.save()

    def fail(self, error: Exception) -> None:
        message = str(error)
        if self.state == "WRITTEN":
            # The files are whole: the run stays at WRITTEN, so that a second call can resume.
            if self.ledger is not None:
                self.ledger.event(self.run_id, "PublishFailed", message)
            return
        ended = {"error_message": message, "finished_at": datetime.now(timezone.utc)}
        self.record("FAILED", **ended)
