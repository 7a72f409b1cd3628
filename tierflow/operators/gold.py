"""Business aggregates per key and per period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period(ts: Column | str, grain: str) -> Column:
    """Start of the period, as a timestamp without zone."""
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def gold_aggregate(
    frame: DataFrame,
    dims: Sequence[str],
    measures: Mapping[str, Column],
    grain: str | None = None,
    ts: str | None = None,
) -> DataFrame:
    """Named measures by dimensions, and by ``period`` when a grain and a time column are given."""
    if (grain is None) != (ts is None):
        raise ValueError("grain and ts go together")
    keys: list = list(dims)
    if grain:
        keys.append(period(ts, grain).alias("period"))
    return frame.groupBy(*keys).agg(*[value.alias(name) for name, value in measures.items()])
