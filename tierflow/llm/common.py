"""Shared pieces: table access, written intermediates, word splitting on bytes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tierflow.session import scratch_path

# A-Z become a-z, letters outside ASCII, a-z and 0-9 stay, everything else becomes a blank. Every
# byte of a character outside ASCII is 0x80 or more, so working on UTF-8 bytes equals working on
# characters.
FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


SLICE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to a fresh path of the shared folder and read back: cuts the lineage, and a
    lost executor cannot take it along. The files stay until the shared folder is cleaned."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    schema = frame.schema
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted. Spark does that when the driver's garbage is
    collected, which may be long after; an operator of several written steps asks for it between them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def learnable(doc_id: Column) -> Column:
    """Whether labels of a document may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fold_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z, as bytes."""
    return text.translate(FOLD).split()


def map_arrow(
    frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` in slices of ``SLICE_ROWS`` rows: an Arrow batch may hold 10,000 texts, and what
    a task makes of them in Python should not all exist at once. Memory that Arrow keeps for later is
    given back when the task ends, for the worker lives on through the stages of a job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(b.slice(low, SLICE_ROWS) for b in batches for low in range(0, b.num_rows, SLICE_ROWS))
        finally:
            pa.default_memory_pool().release_unused()

    return frame.mapInArrow(run, schema)


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in columns.values()],
        names=list(columns),
    )


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
