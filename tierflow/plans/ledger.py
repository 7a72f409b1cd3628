"""The run ledger: one appended row per state change and per event."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from tierflow.operators.changes import notes_in, read_note, remove_folder, write_note


def _schema(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


_TEXT, _INT, _TIME = StringType(), IntegerType(), TimestampType()

RUNS_SCHEMA = _schema(
    run_id=_TEXT,
    spark_application=_TEXT,
    state=_TEXT,
    error_message=_TEXT,
    sql=_TEXT,
    source=_TEXT,
    destination=_TEXT,
    submitted_at=_TIME,
    started_at=_TIME,
    finished_at=_TIME,
    executor_instances=_INT,
    executor_cores=_INT,
    executor_memory=_TEXT,
    driver_cores=_INT,
    driver_memory=_TEXT,
    rows_out=LongType(),
    submission_attempts=_INT,
    execution_attempts=_INT,
    recorded_at=_TIME,
    name=_TEXT,
    schedule_type=_TEXT,
    interval_seconds=LongType(),
    spark_version=_TEXT,
    application_id=_TEXT,
)
EVENTS_SCHEMA = _schema(
    run_id=_TEXT, time=_TIME, type=_TEXT, reason=_TEXT, message=_TEXT, object=_TEXT
)


def application_name(run_id: str) -> str:
    return f"sql-exec-{run_id}"


class RunLedger:
    """Ledger below a folder, laid out as ``runs/day=…/run=…`` and ``events/day=…/run=…``.

    Every run writes only into folders of its own, so runs that finish at the same time cannot
    disturb each other's commit, and readers can prune by day. A state change is an event in itself;
    the ``events`` folder holds only what is not one. ``compact`` packs the many small files into few.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def record(self, run_id: str, state: str, **fields: object) -> None:
        self.record_all(run_id, [{"state": state, **fields}])

    def record_all(self, run_id: str, changes: Sequence[Mapping[str, object]]) -> None:
        """Append several state changes of a run in one write."""
        identity = {"run_id": run_id, "spark_application": application_name(run_id)}
        rows = [{"recorded_at": datetime.now(timezone.utc), **c, **identity} for c in changes]
        self._append("runs", RUNS_SCHEMA, run_id, rows)

    def event(self, run_id: str, reason: str, message: str, kind: str = "Warning") -> None:
        row = {
            "run_id": run_id,
            "time": datetime.now(timezone.utc),
            "type": kind,
            "reason": reason,
            "message": message,
            "object": f"SparkApplication/{application_name(run_id)}",
        }
        self._append("events", EVENTS_SCHEMA, run_id, [row])

    def runs(self, run_id: str | None = None) -> DataFrame:
        return self._read("runs", RUNS_SCHEMA, run_id)

    def events(self, run_id: str | None = None) -> DataFrame:
        changes = self.runs(run_id).select(
            "run_id",
            F.col("recorded_at").alias("time"),
            F.when(F.col("state") == "FAILED", "Warning").otherwise("Normal").alias("type"),
            F.col("state").alias("reason"),
            F.coalesce("error_message", F.concat(F.lit("run is "), "state")).alias("message"),
            F.concat(F.lit("SparkApplication/"), "spark_application").alias("object"),
        )
        return changes.unionByName(self._read("events", EVENTS_SCHEMA, run_id))

    def _append(
        self, table: str, schema: StructType, run_id: str, rows: Sequence[Mapping[str, object]]
    ) -> None:
        unknown = {name for row in rows for name in row} - set(schema.fieldNames())
        if unknown:
            raise ValueError(f"not ledger columns: {sorted(unknown)}")
        one = self.spark.sql("SELECT 1")
        frames = [
            one.select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
            for row in rows
        ]
        day = datetime.now(timezone.utc).date().isoformat()
        folder = f"{self.root}/{table}/day={day}/run={run_id}"
        reduce(DataFrame.union, frames).coalesce(1).write.mode("append").parquet(folder)

    def compact(self, target_bytes: int = 128 << 20, keep_seconds: int = 3600) -> dict[str, int]:
        """Pack the small files of both tables into files of about ``target_bytes``; returns how many files
        each table is read from afterwards.

        Packed files lie where no listing sees them. One note, renamed into place, says which file
        stands for which others, so a reader sees all of a pack or none of it. Files that have been replaced
        are deleted by a later call, ``keep_seconds`` after, so that readers that had listed them find them.
        One call at a time; runs may go on writing meanwhile.
        """
        return {table: self._compact(table, schema, target_bytes, keep_seconds) for table, schema in _TABLES.items()}

    def _compact(self, table: str, schema: StructType, target_bytes: int, keep_seconds: int) -> int:
        now, root = datetime.now(timezone.utc).timestamp(), f"{self.root}/{table}"
        for name, pack in self._packs(table).items():
            if pack["replaces"] and now - pack["at"] >= keep_seconds:
                for file in pack["replaces"]:
                    remove_folder(self.spark, file)
                write_note(self.spark, f"{root}/{PACKS}/{name}", {**pack, "replaces": []})
        files = self._files(table)
        small = {f: n for f, n in files.items() if n < target_bytes // 2}
        for group in pack_first_fit(small, target_bytes):
            if len(group) < 2:
                continue
            name = uuid.uuid4().hex
            data = f"{root}/{PACKED}/{name}"
            self.spark.read.schema(schema).parquet(*group).coalesce(1).write.parquet(data)
            # A pack of packs takes over what they replace, and they go with it.
            inner = {n: p for n, p in self._packs(table).items() if any(f.startswith(f"{p['folder']}/") for f in group)}
            replaced = [*group, *(f for p in inner.values() for f in p["replaces"])]
            note = {"folder": data, "replaces": replaced, "at": now, "packs": list(inner)}
            write_note(self.spark, f"{root}/{PACKS}/{name}", note)
        return len(self._files(table))

    def _packs(self, table: str) -> dict[str, dict]:
        root = f"{self.root}/{table}/{PACKS}"
        found = {name: read_note(self.spark, f"{root}/{name}") for name in notes_in(self.spark, root)}
        inside = {n for pack in found.values() for n in pack["packs"]}
        return {name: pack for name, pack in found.items() if name not in inside}

    def _files(self, table: str) -> dict[str, int]:
        """Files that hold the table's rows, with their sizes. The notes are read before the folder is
        listed: a pack that appears in between is not seen, and its files still are."""
        packs = self._packs(table)
        gone = {f for pack in packs.values() for f in pack["replaces"]}
        found = data_files(self.spark, f"{self.root}/{table}")
        for pack in packs.values():
            found |= data_files(self.spark, pack["folder"])
        return {f: n for f, n in found.items() if f not in gone}

    def _read(self, table: str, schema: StructType, run_id: str | None) -> DataFrame:
        if notes_in(self.spark, f"{self.root}/{table}/{PACKS}"):
            files = list(self._files(table))
            frame = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
            return frame.filter(F.col("run_id") == run_id) if run_id else frame
        folder = f"{self.root}/{table}"
        if run_id:
            folder += f"/day=*/run={run_id}"
        try:
            frame = self.spark.read.schema(schema).parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return frame.select(*schema.fieldNames())


_TABLES = {"runs": RUNS_SCHEMA, "events": EVENTS_SCHEMA}
# Hidden from readers of the folders by their underscores.
PACKS = "_packs"
PACKED = "_packed"


def pack_first_fit(sizes: Mapping[str, int], target: int) -> list[list[str]]:
    """Groups of files of ``target`` bytes together at most, the largest files first, each into the first
    group that has room. A file of more than that is a group of its own."""
    groups: list[list[str]] = []
    room: list[int] = []
    for file in sorted(sizes, key=lambda f: (-sizes[f], f)):
        at = next((i for i, left in enumerate(room) if sizes[file] <= left), None)
        if at is None:
            groups.append([])
            room.append(target)
            at = len(groups) - 1
        groups[at].append(file)
        room[at] -= sizes[file]
    return groups


def data_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files below a folder that readers would see, with their sizes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    top = files.makeQualified(place).toString()
    found, walk = {}, files.listFiles(place, True)
    while walk.hasNext():
        status = walk.next()
        name = status.getPath().toString()
        parts = name[len(top) :].strip("/").split("/")
        if not any(p.startswith(".") or (p.startswith("_") and "=" not in p) for p in parts):
            found[name] = status.getLen()
    return found
