"""Row counts, previews and schema reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(sources: Mapping[str, DataFrame]) -> DataFrame:
    """``source, row_count`` per named relation, as one lazy plan that reads no column data."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("source"), "row_count"
        )
        for name, frame in sources.items()
    ]
    return reduce(DataFrame.union, counts)


def preview(frame: DataFrame, n: int = 10, order_by: list | None = None) -> DataFrame:
    """First ``n`` rows: any rows without an order, a distributed top-k with one."""
    return (frame.orderBy(*order_by) if order_by else frame).limit(n)


def schema_report(frame: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in frame.schema.fields]
    return frame.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")
