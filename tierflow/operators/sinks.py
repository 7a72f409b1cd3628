"""File sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tierflow.functions.naming import normalize_path


def _location(path: str) -> str:
    bare = normalize_path(path)
    bare = bare.removeprefix("file:")
    return "/" + bare.strip("/") if bare.startswith("/") else bare.rstrip("/")


def overlaps(path: str, others: Iterable[str]) -> str | None:
    """The first of ``others`` that is the same folder as ``path``, inside it or around it."""
    mine = _location(path) + "/"
    for other in others:
        theirs = _location(other) + "/"
        if mine.startswith(theirs) or theirs.startswith(mine):
            return other
    return None


# Spark's JSON writer prints milliseconds and leaves NULL fields out unless told otherwise.
LOSSLESS_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def source_folders(frame: DataFrame) -> list[str]:
    """Root paths of the file relations that a frame reads, subqueries and views included."""
    plan = frame._jdf.queryExecution().analyzed()
    subqueries = plan.subqueriesAll()
    plans = [plan, *(subqueries.apply(i) for i in range(subqueries.size()))]
    found: list[str] = []
    for one in plans:
        leaves = one.collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if leaf.getClass().getSimpleName() != "LogicalRelation":
                continue
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                roots = relation.location().rootPaths()
                found += [roots.apply(i).toString() for i in range(roots.size())]
    return list(dict.fromkeys(found))


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(normalize_path(path))
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_files(
    frame: DataFrame,
    path: str,
    mode: str = "overwrite",
    *,
    format: str = "parquet",
    files: int | None = None,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    max_records_per_file: int | None = None,
    reads: Iterable[str] = (),
) -> int:
    """Write once and return the number of rows, counted during the write.

    ``partition_by`` and ``files`` use Spark's REBALANCE: rows of a partition value are brought
    together to avoid small files, while a crowded value, or a result larger than the advisory
    partition size, is still cut into several tasks and files. ``files=1`` therefore gives one file
    for a small result and never pulls a large one into one task.

    Overwriting an input is refused, since Spark deletes the target before it reads: inputs are the
    folders that the frame's plan reads, and ``reads``. So is writing into the folder of a stream,
    whose own list of files would hide the rows. JSON keeps microseconds and NULL fields.
    """
    if mode not in ("append", "overwrite", "error"):
        raise ValueError(f"unknown write mode {mode!r}")
    if mode == "overwrite":
        clash = overlaps(path, [*reads, *source_folders(frame)])
        if clash:
            raise ValueError(f"refusing to overwrite {path}: it overlaps the source {clash}")
    if files is not None and files < 1:
        raise ValueError("files must be at least 1")
    if path_exists(frame.sparkSession, f"{path.rstrip('/')}/_spark_metadata"):
        raise ValueError(f"refusing to write into {path}: a stream writes there, and readers see only its files")

    shaped = frame
    if partition_by:
        shaped = shaped.hint("rebalance", *([files] if files else []), *partition_by)
    elif files:
        shaped = shaped.hint("rebalance", files)
    if sort_by:
        shaped = shaped.sortWithinPartitions(*partition_by, *sort_by)
    # Observed last: a result task is counted once, however often its inputs are recomputed.
    written = Observation()
    writer = shaped.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if format == "json":
        writer = writer.options(**LOSSLESS_JSON)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(format).save(path)
    return written.get["rows"]


# A partition column: readers see its folders in spite of the underscore.
RUN = "_run"


def write_run(frame: DataFrame, path: str, run_id: str) -> int:
    """Write the rows of a run as a partition of their own below ``path``, in place of what the same run
    has written there before; returns how many. Rows of other runs are not touched."""
    if RUN in frame.columns:
        raise ValueError(f"the rows must not have a column {RUN}")
    spark = frame.sparkSession
    if path_exists(spark, path):
        place = spark._jvm.org.apache.hadoop.fs.Path(normalize_path(path))
        names = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
        if any(not n.startswith((".", "_")) for n in names):
            raise ValueError(f"refusing to write runs into {path}: it holds files that belong to none")
    written = Observation()
    rows = frame.withColumn(RUN, F.lit(run_id)).observe(written, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(RUN).parquet(path)
    return written.get["rows"]


def run_rows(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Rows below ``path`` with the ``_run`` they belong to as text, of one run or of all."""
    if run_id is None:
        found = spark.read.parquet(path)
        return found.withColumn(RUN, F.col(RUN).cast("string"))
    return spark.read.parquet(f"{path.rstrip('/')}/{RUN}={run_id}").withColumn(RUN, F.lit(run_id))
