"""Deduplication of whole rows, or to the newest row of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.functions.naming import free_name, quoted


def dedup_exact(frame: DataFrame) -> DataFrame:
    """One of each distinct row; copies already collapse before the shuffle."""
    return frame.dropDuplicates()


def dedup_latest(
    frame: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str]
) -> DataFrame:
    """The first row of each key under ``order_by``, which must leave no ties.

    Spark turns the rank-one filter into a group limit on both sides of the shuffle: every task
    sends at most one row per key, so a key with a third of all rows costs no more than others.
    """
    rank = free_name(frame, "_dedup_rank")
    order = [quoted(o) if isinstance(o, str) else o for o in order_by]
    window = Window.partitionBy(*map(quoted, keys)).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)
