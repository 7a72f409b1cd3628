"""Changes to a partitioned folder that may be cut off between any two steps and called again.

A change has an id. Its new partitions are first written whole to the shared folder, then swapped in by a
dynamic partition overwrite, then marked as done. Called again with the same id, a change that is done does
nothing, one that is written whole is only swapped in again, and any other begins anew. One change at a
time may work on a folder. A reader in the moment of the swap may miss a partition.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tierflow.operators.sinks import path_exists, write_files
from tierflow.session import workspace

# Hidden from readers of the folder by its underscore.
DONE = "_done"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_note(spark: SparkSession, path: str, content: object) -> None:
    """A small JSON file, whole or not at all: it is written under another name and renamed."""
    place, files = _place(spark, path)
    beside, _ = _place(spark, f"{path}.new")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    files.delete(place, False)
    if not files.rename(beside, place):
        raise OSError(f"cannot write {path}")


def read_note(spark: SparkSession, path: str) -> object | None:
    """Content of a note, or None."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def notes_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the notes in a folder, none if it is missing."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(n for n in names if not n.endswith(".new"))


def remove_folder(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def staging_path(spark: SparkSession, path: str, change_id: str) -> str:
    """Where a change of a folder is prepared; known from the two alone."""
    key = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:16]
    return f"{workspace(spark)}/tierflow/changes/{key}/{_safe(change_id)}"


def _safe(change_id: str) -> str:
    if not change_id or not all(c.isalnum() or c in "-_." for c in change_id) or change_id.startswith("."):
        raise ValueError(f"a change id has letters, digits, '-', '_' and '.', got {change_id!r}")
    return change_id


def change_done(spark: SparkSession, path: str, change_id: str) -> dict | None:
    """What a change that is done has noted, or None."""
    return read_note(spark, f"{path.rstrip('/')}/{DONE}/{_safe(change_id)}")


def replace_partitions(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    partition_by: Sequence[str],
    change_id: str,
    *,
    noted: dict | None = None,
) -> dict:
    """Swap in the partitions that occur in the frame that ``build`` gives; others are not touched.

    ``build`` may read the folder itself, and is not called for a change that is written already. Returns
    ``rows`` (in the new partitions) and what is ``noted``.
    """
    path = path.rstrip("/")
    done = change_done(spark, path, change_id)
    if done is not None:
        remove_folder(spark, staging_path(spark, path, change_id))
        return done
    staged = staging_path(spark, path, change_id)
    whole = read_note(spark, f"{staged}/_whole")
    if whole is None:
        remove_folder(spark, staged)
        frame = build()
        rows = write_files(frame, f"{staged}/rows", "overwrite", partition_by=partition_by)
        whole = {"rows": rows, "schema": frame.schema.json(), **(noted or {})}
        write_note(spark, f"{staged}/_whole", whole)
    schema = StructType.fromJson(json.loads(whole["schema"]))
    swap_in(spark.read.schema(schema).parquet(f"{staged}/rows"), path, partition_by)
    done = {k: v for k, v in whole.items() if k != "schema"}
    write_note(spark, f"{path}/{DONE}/{change_id}", done)
    remove_folder(spark, staged)
    return done


def swap_in(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that occur in ``frame``, and no others."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def partition_values(frame: DataFrame, names: Iterable[str]) -> list[tuple]:
    """Distinct values of partition columns: as many as a folder has partitions, which is few by design."""
    return [tuple(r) for r in frame.select(*names).distinct().collect()]


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether a folder has anything that its readers would see."""
    if not path_exists(spark, path):
        return False
    place, files = _place(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return any(not n.startswith(".") and (not n.startswith("_") or "=" in n) for n in names)
