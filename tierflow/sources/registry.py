"""Lookups over the registry table of sources and sinks
(``id, name, type_name, workspace_id, kind, position, bucket``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_registry(registry: DataFrame, kind: str) -> DataFrame:
    """Entries of one kind (``source`` or ``sink``) with missing texts shown as empty."""
    texts = ["id", "name", "type_name", "workspace_id"]
    return registry.filter(F.col("kind") == kind).select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts], "position"
    )


def resolve_source(
    registry: DataFrame, type_name: str = "s3", fallback_bucket: str | None = None
) -> str:
    """Bucket of the first registered sink of a type (any case), else the fallback, else an error."""
    first = (
        registry.filter((F.col("kind") == "sink") & (F.lower("type_name") == type_name.lower()))
        .orderBy("position")
        .select("bucket")
        .head(1)
    )
    bucket = first[0]["bucket"] if first else fallback_bucket
    if not bucket:
        raise ValueError(f"no {type_name} sink is registered and no fallback bucket is set")
    return bucket
