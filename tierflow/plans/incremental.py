"""Gold aggregates kept up to date by recomputing only the periods that new loads touch."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tierflow.functions.naming import quoted
from tierflow.operators.changes import notes_in, read_note, replace_partitions, swap_in, write_note
from tierflow.operators.gold import period

PERIOD = "_period"
LOAD = "_load"
LOADS = "_loads"
APPLIED = "_applied"
NO_PERIOD = "none"


def _text(ts: str, grain: str) -> Column:
    return F.coalesce(F.date_format(F.date_trunc(grain, quoted(ts)), "yyyy-MM-dd-HH"), F.lit(NO_PERIOD))


def load_periods(frame: DataFrame, path: str, load_id: str, ts: str, grain: str = "month") -> dict:
    """Append a load to a silver folder laid out by period and load, and note which periods it touches.

    Rows of a load sit in partitions of their own, so a load that was cut off and is called again with its
    ``load_id`` leaves each row once. A load that is noted already is left alone. Rows without a time make
    a period of their own. Returns ``rows`` and ``periods``.
    """
    spark, path = frame.sparkSession, path.rstrip("/")
    known = read_note(spark, f"{path}/{LOADS}/{load_id}")
    if known is not None:
        return known
    marked = frame.withColumn(PERIOD, _text(ts, grain)).withColumn(LOAD, F.lit(load_id))
    swap_in(marked.hint("rebalance", PERIOD), path, [PERIOD, LOAD])
    # From the footers of the load's own files; one row per period.
    there = spark.read.schema(marked.schema).parquet(path).filter(F.col(LOAD) == load_id)
    counts = dict(map(tuple, there.groupBy(PERIOD).count().collect()))
    note = {"rows": sum(counts.values()), "periods": sorted(counts)}
    write_note(spark, f"{path}/{LOADS}/{load_id}", note)
    return note


def silver_rows(spark: SparkSession, path: str, schema: StructType, periods: Sequence[str] | None = None) -> DataFrame:
    """Rows of a silver folder with their ``_period``; only those of ``periods`` if given, by a filter that
    leaves whole folders out."""
    whole = StructType([*schema.fields, StructField(PERIOD, StringType()), StructField(LOAD, StringType())])
    rows = spark.read.schema(whole).parquet(path).drop(LOAD)
    return rows if periods is None else rows.filter(F.col(PERIOD).isin(*periods))


def refresh_gold(
    spark: SparkSession,
    silver: str,
    schema: StructType,
    gold: str,
    dims: Sequence[str],
    measures: Mapping[str, Column],
    ts: str,
    grain: str = "month",
) -> list[str]:
    """Recompute the periods of ``gold`` that loads of ``silver`` have touched since the last refresh.

    ``measures`` are aggregates over the rows of a period and ``dims``, any that Spark knows, for a period
    is recomputed from all of its rows. The new periods are swapped in at once (see ``changes.py``); other
    periods are neither read nor written. A refresh that was cut off is finished by the next call. Returns
    the recomputed periods, none if there was no new load. ``grain`` is that of the loads.
    """
    silver, gold = silver.rstrip("/"), gold.rstrip("/")
    done = set(notes_in(spark, f"{gold}/{APPLIED}"))
    pending = [load for load in notes_in(spark, f"{silver}/{LOADS}") if load not in done]
    if not pending:
        return []
    touched = sorted({p for load in pending for p in read_note(spark, f"{silver}/{LOADS}/{load}")["periods"]})
    if touched:
        change_id = hashlib.sha256("\n".join(pending).encode()).hexdigest()[:32]

        def build() -> DataFrame:
            rows = silver_rows(spark, silver, schema, touched)
            keys = [*map(quoted, dims), period(quoted(ts), grain).alias("period"), PERIOD]
            return rows.groupBy(*keys).agg(*[value.alias(name) for name, value in measures.items()])

        replace_partitions(spark, build, gold, [PERIOD], change_id, noted={"periods": touched})
    for load in pending:
        write_note(spark, f"{gold}/{APPLIED}/{load}", {"periods": touched})
    return touched


def gold_rows(spark: SparkSession, gold: str) -> DataFrame:
    """The rows of a gold folder, without the column that lays it out."""
    return spark.read.parquet(gold).drop(PERIOD)
