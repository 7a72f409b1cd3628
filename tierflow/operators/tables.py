"""Catalog table sinks.

Tables of other catalogs go through ``writeTo``. Spark's built-in session catalog holds v1 tables,
which refuse those calls, so it is served by ``saveAsTable`` and ``insertInto``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.naming import split_table_name
from tierflow.session import scratch_path

SESSION_CATALOG = "spark_catalog"
MODES = ("append", "overwrite", "replace")


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def ensure_namespace(spark: SparkSession, catalog: str, namespace: str) -> str | None:
    """Create the namespace; a failure is returned as a warning text, not raised, because catalogs
    may forbid it while the namespace is already there."""
    try:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{catalog}`.`{namespace}`")
    except Exception as error:  # any catalog implementation may raise its own kind
        return str(error).splitlines()[0]
    return None


def is_missing_table(error: AnalysisException) -> bool:
    return error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND"


def publish_table(
    frame: DataFrame,
    name: str,
    mode: str = "append",
    *,
    partition_by: Sequence[str] = (),
    path: str | None = None,
) -> None:
    """Publish to ``catalog.namespace.table``.

    ``append`` creates a missing table; ``overwrite`` replaces only the partitions that occur in
    ``frame``, creating a missing table; ``replace`` replaces the whole table. Only a missing table
    leads to creation: any other error is raised.

    ``replace`` in the session catalog keeps the old table until the new rows are all written: they
    go to a table of another name, which then takes the old one's place. ``path`` puts a
    session-catalog table at a location of its own; there the rows are written to the shared folder
    first and copied from it, since two tables cannot take turns at one location. A failure of that
    last copy, or of the rename, is the only point where the old table is gone; the new rows are then
    whole in the named place.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    catalog, _, _ = split_table_name(name)
    if catalog == SESSION_CATALOG:
        _publish_session(frame, _quoted(name), mode, partition_by, path)
    else:
        _publish_v2(frame, _quoted(name), mode, partition_by)


def _publish_v2(frame: DataFrame, name: str, mode: str, partition_by: Sequence[str]) -> None:
    def writer(create: bool = False):
        target = frame.writeTo(name)
        return target.partitionedBy(*map(F.col, partition_by)) if create and partition_by else target

    if mode == "replace":
        writer(create=True).createOrReplace()
        return
    try:
        if mode == "append":
            writer().append()
        else:
            writer().overwritePartitions()
    except AnalysisException as error:
        if not is_missing_table(error):
            raise
        # create, not createOrReplace: a table made by someone else meanwhile must survive.
        writer(create=True).create()


def _publish_session(
    frame: DataFrame, name: str, mode: str, partition_by: Sequence[str], path: str | None
) -> None:
    spark = frame.sparkSession

    def save(save_mode: str, rows: DataFrame = frame, to: str = name) -> None:
        writer = rows.write.format("parquet").mode(save_mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(to)

    if mode == "replace":
        _replace_session(frame, name, path, save)
    elif mode == "append":
        save("append")
    elif not spark.catalog.tableExists(name):
        save("error")
    else:
        # insertInto matches by position, so the table's own column order comes first.
        ordered = frame.select(*[F.col(f"`{c}`") for c in spark.table(name).columns])
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            ordered.write.insertInto(name, overwrite=True)


def _replace_session(frame: DataFrame, name: str, path: str | None, save: Callable) -> None:
    spark = frame.sparkSession
    if not spark.catalog.tableExists(name):
        save("error")
    elif path:
        staged = scratch_path(spark, "replace")
        frame.write.parquet(staged)
        try:
            save("overwrite", spark.read.schema(frame.schema).parquet(staged))
        except Exception as error:
            error.add_note(f"the new rows of {name} are in {staged}")
            raise
    else:
        other = f"{name[:-1]}_{uuid.uuid4().hex[:12]}`"
        try:
            save("error", frame, other)
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {other}")
            raise
        spark.sql(f"DROP TABLE {name}")
        # The new name is given without its catalog, as the session catalog wants it.
        spark.sql(f"ALTER TABLE {other} RENAME TO {name.split('.', 1)[1]}")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    # insertInto takes this choice from the session only; as a writer option it is ignored and every
    # partition would be lost.
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
