"""Join helpers: broadcasts behind a size check, and row marking that survives crowded keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierflow.session import scratch_path

# Rows without a key match nothing; they are dealt out over this many pieces.
PIECES_WITHOUT_KEY = 100_000


@dataclass(frozen=True)
class KeyLimits:
    """``broadcast_bytes``: key lists up to this measured size are broadcast. ``rows_per_piece``: a
    key with more rows than this is cut into pieces of about this many rows when rows are shuffled."""

    broadcast_bytes: int = 64 << 20
    rows_per_piece: int = 5_000_000


def broadcast_if_small(frame: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast when the optimiser's size estimate is within ``max_bytes``.

    The estimate comes from the plan (file sizes, or statistics of a table), so no job is started. A
    relation of larger or unknown size comes back without a hint, and Spark chooses the join.
    """
    estimate = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return frame.hint("broadcast") if int(str(estimate)) <= max_bytes else frame


def _fields(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in columns]


def all_set(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [field.isNotNull() for field in _fields(columns)])


def key_sizes(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns, _size``: rows per key, counted before the shuffle, so that a crowded key travels as
    one row per task."""
    return frame.groupBy(*_fields(columns)).agg(F.count(F.lit(1)).alias("_size"))


def mark_by_key(
    frame: DataFrame,
    judged: DataFrame,
    columns: Sequence[str],
    mark: str,
    limits: KeyLimits = KeyLimits(),
) -> DataFrame:
    """All rows of ``frame`` plus a boolean ``mark``: whether their key is judged ``_bad``.

    ``judged`` holds every key of ``frame`` once, as ``columns, _size, _bad``. Its bad and crowded
    keys are written to the shared folder right away, and what the write has counted decides how the
    rows are marked:

    - no bad key: no join at all;
    - bad keys small enough: a broadcast join, so the rows are not shuffled;
    - otherwise a shuffled join. Rows of a crowded key are dealt out over pieces, and its entry is
      repeated for each piece, so no task receives a whole crowded key. Rows with a NULL in the key
      match nothing and are dealt out too.
    """
    kept = judged.filter(all_set(columns) & (F.col("_bad") | (F.col("_size") > limits.rows_per_piece)))
    # Room for the hash table entry, and the key itself as text.
    width = reduce(Column.__add__, [F.octet_length(f.cast("string")) for f in _fields(columns)], F.lit(100))
    counted = Observation()
    path = scratch_path(frame.sparkSession, "keys")
    kept.observe(
        counted, F.coalesce(F.sum(F.when(F.col("_bad"), width)), F.lit(0)).alias("bytes")
    ).write.parquet(path)
    needed = counted.get["bytes"]
    if not needed:
        return frame.withColumn(mark, F.lit(False))

    written = frame.sparkSession.read.parquet(path)
    names = [f"_key{i}" for i in range(len(columns))]
    bad = written.filter(F.col("_bad"))
    key = [value.alias(name) for value, name in zip(_fields(columns), names)]
    same = reduce(Column.__and__, [v == F.col(n) for v, n in zip(_fields(columns), names)])
    result = [*_fields(frame.columns), F.coalesce("_found", F.lit(False)).alias(mark)]
    if needed <= limits.broadcast_bytes:
        entries = bad.select(*key, F.lit(True).alias("_found")).hint("broadcast")
        return frame.join(entries, same, "left").select(*result)

    crowded = _crowded(written, columns, limits.rows_per_piece)
    by_hash = F.xxhash64(*_fields(columns)) == F.col("_hash")
    pieces = F.when(all_set(columns), F.coalesce("_pieces", F.lit(1))).otherwise(PIECES_WITHOUT_KEY)
    rows = frame.join(crowded, by_hash, "left").select(
        *_fields(frame.columns), (F.monotonically_increasing_id() % pieces).alias("_piece")
    )
    every_piece = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    entries = bad.join(crowded, by_hash, "left").select(
        *key, F.explode(every_piece).alias("_entry"), F.lit(True).alias("_found")
    )
    return rows.join(entries, same & (F.col("_piece") == F.col("_entry")), "left").select(*result)


def _crowded(written: DataFrame, columns: Sequence[str], rows_per_piece: int) -> DataFrame:
    """``_hash, _pieces`` of crowded keys, for broadcast.

    There can be at most one such key, of 16 bytes however long the key itself is, per
    ``rows_per_piece`` rows of input: 3.2 MB for 10^12 rows. The hash only decides how many pieces
    are made; the join compares the keys, so a collision costs a little copying and nothing else.

    Adaptive skew handling is no substitute for the pieces: it leaves a join alone when one side is
    more than a sorted shuffle, and whenever the split would need another shuffle above.
    """
    pieces = F.ceil(F.col("_size") / F.lit(rows_per_piece)).cast("bigint")
    return (
        written.filter(F.col("_size") > rows_per_piece)
        .groupBy(F.xxhash64(*_fields(columns)).alias("_hash"))
        .agg(F.sum(pieces).alias("_pieces"))
        .hint("broadcast")
    )
