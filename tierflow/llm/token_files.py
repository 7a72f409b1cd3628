"""Operator 4: token ids of a corpus as binary files of Simple-8b blocks, in document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierflow.llm import simple8b
from tierflow.llm.chunks import WordEndEncoder, encoder
from tierflow.llm.common import batch, col, map_arrow, texts_of
from tierflow.session import scratch_path

SHARD_IDS = 1 << 18
STEP_DOCS = 256
# Input of a range at most, going by the plan's estimate, which is only believed up to a petabyte.
RANGE_BYTES = 256 << 20
MAX_BYTES = 1 << 50

SHARDS = "part int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<int>, payload binary"


def _shards(tokenizer_path: str, end_id: int, shard_ids: int):
    """Encoder task: rows arrive in document order, full shards leave as soon as they are complete.
    A document is never cut; a shard ends with the first document that fills it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(WordEndEncoder, tokenizer_path)
        part, first = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4")
        ids: list[np.ndarray] = []
        size = 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def shard() -> pa.RecordBatch:
            data = simple8b.encode(np.concatenate(ids))
            return batch(
                {
                    "part": ([part], pa.int32()),
                    "first": ([first], pa.int64()),
                    "n_ids": ([size], pa.int64()),
                    "doc_ids": ([doc_ids], pa.list_(pa.int64())),
                    "lengths": ([lengths], pa.list_(pa.int32())),
                    "payload": ([data], pa.binary()),
                }
            )

        for b in batches:
            names, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for low in range(0, len(names), STEP_DOCS):
                part_names = names[low : low + STEP_DOCS]
                for name, found in zip(part_names, tokens.encode(texts[low : low + STEP_DOCS])):
                    ids += found, end
                    doc_ids.append(name)
                    lengths.append(len(found) + 1)
                    size += len(found) + 1
                    if size >= shard_ids:
                        yield shard()
                        first += size
                        ids, doc_ids, lengths, size = [], [], [], 0
        if doc_ids:
            yield shard()

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode whole texts with the tokenizers library, add ``end_id`` to each and write the ids to
    ``path`` in ascending order of the document id.

    Documents are dealt out by ranges of their id, as many as shuffle partitions or as the size of the
    input asks for, so file number and place inside the file give the
    order. Each file (Parquet, for Spark's task commit) holds shards of about ``shard_ids`` ids: a
    Simple-8b byte string with per-block offsets, its documents' ids and lengths, and how many ids
    of the file precede it. A retried task writes the same file again.

    Null text counts as empty and becomes the end id alone. A null id comes first. Rows with the same
    id are all kept, ordered by text. An empty table gives files without shards. Other columns are
    not looked at.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-min(size, MAX_BYTES) // RANGE_BYTES))
    rows = docs.select(col(id_column).cast("bigint").alias("d"), F.coalesce(col(text_column), F.lit("")).alias("t"))
    # The hash spreads a crowded id over several ranges; inside a range, equal rows are neighbours.
    rows = rows.withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(parts, "d", "h").sortWithinPartitions("d", "h", "t").select("d", "t")
    shards = map_arrow(ordered, _shards(tokenizer_path, end_id, shard_ids), SHARDS)
    shards.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            ids = simple8b.decode(row["payload"]).astype("<u4")
            ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
            starts = ends - row["lengths"]
            raw = ids.tobytes()
            yield batch(
                {
                    "doc_id": (row["doc_ids"], pa.int64()),
                    "start": (starts + row["before"], pa.int64()),
                    "n_tokens": (row["lengths"], pa.int64()),
                    "ids_crc32": ([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)], pa.int64()),
                }
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    (with the end id) and ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers).

    Only one row per file meets in one task, to sum up what precedes each file: 16 bytes each, as
    many as the writer made range partitions, which also bounds the broadcast.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    running = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("part", F.coalesce(running, F.lit(0)).alias("file_start"))
    placed = shards.join(F.broadcast(starts), "part").select(
        "doc_ids", "lengths", "payload", (F.col("file_start") + F.col("first")).alias("before")
    )
    return map_arrow(placed, _documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files below the shared folder and describe what reading them gives back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path)
    return read_token_files(docs.sparkSession, path)
