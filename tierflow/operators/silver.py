"""Schema standardisation and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType, StringType, StructType

from tierflow.functions.naming import sanitize


def standardize(frame: DataFrame, schema: StructType | str) -> DataFrame:
    """Declared columns in declared order and type.

    Incoming names are sanitised before they are matched, a value that does not convert becomes
    NULL, and so does a missing column. A number with a fraction does not convert to a whole type.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found: dict[str, str] = {}
    for name in frame.columns:
        clean_name = sanitize(name)
        if clean_name in found:
            raise ValueError(f"columns {found[clean_name]!r} and {name!r} are both {clean_name!r}")
        found[clean_name] = name
    kinds = {field.name: field.dataType for field in frame.schema.fields}
    return frame.select(*[_declared(field.name, field.dataType, found, kinds) for field in target.fields])


def _declared(name: str, data_type, found: dict[str, str], kinds: dict) -> Column:
    source = found.get(sanitize(name))
    value = F.lit(None).cast(data_type) if source is None else F.col(f"`{source}`")
    converted = value.try_cast(data_type)
    if source is not None and isinstance(data_type, IntegralType):
        kind = kinds[source]
        if isinstance(kind, (FractionalType, StringType)):
            # Spark itself would cut 3.7 to 3.
            number = value.try_cast("decimal(38,18)")
            converted = F.when(number.isNull() | (number == F.floor(number)), converted)
    return converted.alias(name)


def clean(frame: DataFrame) -> DataFrame:
    """Trim texts, turn empty ones into NULL, and drop rows in which nothing is left."""
    columns = []
    for field in frame.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType):
            value = F.nullif(F.trim(value), F.lit("")).alias(field.name)
        columns.append(value)
    return frame.select(*columns).dropna("all")
