"""Root-level flattening of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flatten_root(frame: DataFrame, sep: str = "_") -> DataFrame:
    """Fields of each top-level struct become columns, one level only; the rest stays as it is."""
    columns = []
    for field in frame.schema.fields:
        if isinstance(field.dataType, StructType):
            columns += [
                F.col(f"`{field.name}`.`{inner}`").alias(f"{field.name}{sep}{inner}")
                for inner in field.dataType.fieldNames()
            ]
        else:
            columns.append(F.col(f"`{field.name}`"))
    flat = frame.select(*columns)
    if len(set(map(str.lower, flat.columns))) < len(flat.columns):
        raise ValueError(f"flattening gives the same column twice: {flat.columns}")
    return flat
