"""Keyed changes (insert, update, delete) merged into a partitioned folder."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tierflow.functions.naming import quoted
from tierflow.operators.changes import (
    change_done,
    holds_files,
    notes_in,
    partition_values,
    read_note,
    remove_folder,
    replace_partitions,
    staging_path,
    write_note,
)
from tierflow.operators.dedup import dedup_latest
from tierflow.session import scratch_path

DELETED = "_deleted"
BUCKET = "_bucket"
LAYOUT = "_layout"


@dataclass(frozen=True)
class UpsertResult:
    """Changes of the batch after each key was cut to its newest, rewritten partitions, rows in them."""

    changes: int
    partitions: int
    rows: int


def upsert(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    version: Sequence[str],
    *,
    change_id: str,
    deleted: Column | None = None,
    partition_by: Sequence[str] = (),
    buckets: int = 64,
) -> UpsertResult:
    """Merge a batch of changes into the folder ``path``, rewriting only the partitions it touches.

    A key's newest change by ``version`` (columns, the most significant first) holds, whatever batch it
    comes in, so batches may come late and in any order. ``deleted`` marks changes that remove their key;
    they are kept, hidden, so that a late older change does not bring the key back. Of changes with equal
    versions a deletion goes first, then the one whose content has the larger hash, in every order. NULL
    keys are keys; a NULL version is the oldest.

    Partitions are ``partition_by``, which must be among the keys so that a key stays in its partition, or
    else ``buckets`` by hash of the key; the first batch settles them. Further columns may be added by a
    later batch; rows without them have NULL. A batch that was cut off is finished by calling again with
    its ``change_id``, one that is done is left alone (see ``changes.py``). Read with ``upserted_rows``.

    Rows of a crowded key are cut to one per task before they are shuffled. An empty batch touches nothing.
    """
    spark, path = changes.sparkSession, path.rstrip("/")
    if set(partition_by) - set(keys):
        raise ValueError("partition columns must be keys, or a key could move")
    if {DELETED, BUCKET} & set(changes.columns):
        raise ValueError(f"the changes must not have columns {DELETED} and {BUCKET}")
    parts = list(partition_by) or [BUCKET]
    layout = _settled(spark, path, changes.schema, {"keys": list(keys), "version": list(version), "parts": parts, "buckets": buckets})
    done = change_done(spark, path, change_id)
    if done is None:
        done = _merge(changes, path, layout, deleted, change_id)
    else:
        remove_folder(spark, staging_path(spark, path, change_id))
    return UpsertResult(done["changes"], done["partitions"], done["rows"])


def _merge(changes: DataFrame, path: str, layout: dict, deleted: Column | None, change_id: str) -> dict:
    spark, keys, parts = changes.sparkSession, layout["keys"], layout["parts"]
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    marked = changes.withColumn(DELETED, gone)
    if parts == [BUCKET]:
        number = F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(layout["buckets"])).cast("int")
        marked = marked.withColumn(BUCKET, number)
    newest = _newest(marked, layout)
    staged = scratch_path(spark, "upsert")
    newest.write.parquet(staged)
    newest = spark.read.schema(newest.schema).parquet(staged)
    touched = partition_values(newest, map(quoted, parts))

    def build() -> DataFrame:
        if not touched or not holds_files(spark, path):
            return newest
        schema = StructType.fromJson(json.loads(layout["schema"]))
        kept = spark.read.schema(_whole(schema, parts)).parquet(path).filter(_in(parts, touched))
        return _newest(kept.unionByName(newest, allowMissingColumns=True), layout)

    noted = {"changes": newest.count(), "partitions": len(touched)}
    done = replace_partitions(spark, build, path, parts, change_id, noted=noted)
    remove_folder(spark, staged)
    return done


def _newest(rows: DataFrame, layout: dict) -> DataFrame:
    content = F.xxhash64(*[quoted(c) for c in sorted(rows.columns) if c not in (DELETED, BUCKET)])
    order = [*[F.desc_nulls_last(f"`{v}`") for v in layout["version"]], F.desc(DELETED), content.desc()]
    return dedup_latest(rows, layout["keys"], order)


def _in(parts: Sequence[str], values: Sequence[tuple]) -> Column:
    """Filter on partition columns that Spark can use to leave out whole folders."""
    if len(parts) == 1:
        known = [v[0] for v in values if v[0] is not None]
        found = quoted(parts[0]).isin(*known) if known else F.lit(False)
        return found | quoted(parts[0]).isNull() if len(known) < len(values) else found
    each = [reduce(Column.__and__, [quoted(p).eqNullSafe(F.lit(x)) for p, x in zip(parts, v)]) for v in values]
    return reduce(Column.__or__, each)


def _whole(schema: StructType, parts: Sequence[str]) -> StructType:
    extra = [StructField(DELETED, BooleanType())]
    if list(parts) == [BUCKET]:
        extra.append(StructField(BUCKET, IntegerType()))
    return StructType([*schema.fields, *extra])


def _settled(spark: SparkSession, path: str, schema: StructType, layout: dict) -> dict:
    """Layout of the folder, settled by its first batch; new columns join its schema."""
    known = _layout(spark, path)
    if known is None:
        if holds_files(spark, path):
            raise ValueError(f"{path} holds files that are not of this layout")
        fields = []
    else:
        different = [k for k in layout if layout[k] != known[k]]
        if different:
            raise ValueError(f"{path} was made with other {', '.join(different)}")
        fields = StructType.fromJson(json.loads(known["schema"])).fields
    kinds = {f.name: f.dataType for f in fields}
    for field in schema.fields:
        if kinds.get(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} is {kinds[field.name].simpleString()}, not {field.dataType.simpleString()}")
    joined = StructType([*fields, *[StructField(f.name, f.dataType) for f in schema.fields if f.name not in kinds]])
    layout = {**layout, "schema": joined.json()}
    if layout != known:
        # A new note for each wider schema, so that there is always a whole one.
        write_note(spark, f"{path}/{LAYOUT}/{len(joined.fields):06d}", layout)
    return layout


def _layout(spark: SparkSession, path: str) -> dict | None:
    names = notes_in(spark, f"{path}/{LAYOUT}")
    return read_note(spark, f"{path}/{LAYOUT}/{names[-1]}") if names else None


def upserted_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an ``upsert`` folder, without the deleted ones."""
    layout = _layout(spark, path.rstrip("/"))
    if layout is None:
        raise ValueError(f"{path} was not made by upsert")
    schema = StructType.fromJson(json.loads(layout["schema"]))
    rows = spark.read.schema(_whole(schema, layout["parts"])).parquet(path)
    return rows.filter(~F.col(DELETED)).select(*map(quoted, schema.fieldNames()))
