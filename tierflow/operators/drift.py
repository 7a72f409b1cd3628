"""Schemas that drift: one type that holds all of several, and a report of what has changed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from tierflow.functions.naming import quoted
from tierflow.operators.changes import read_note, write_note

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
# Decimal digits that a whole type needs.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 20}
# Whole numbers that a fraction type holds exactly.
_EXACT = {FloatType: (ByteType, ShortType), DoubleType: (ByteType, ShortType, IntegerType)}


def widened(a: DataType, b: DataType) -> DataType | None:
    """The least type that holds every value of both without loss, or None if there is none.

    Whole numbers grow up to BIGINT and go into a decimal, or into a fraction type that holds them exactly;
    decimals grow to 38 digits; a date goes into a timestamp without zone. Structs are joined by field,
    arrays and maps by element. The order of the two does not matter but for the order of a struct's fields.
    """
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    for x, y in ((a, b), (b, a)):
        if isinstance(x, _WHOLE) and isinstance(y, DecimalType):
            return _decimal(DecimalType(_DIGITS[type(x)], 0), y)
        if isinstance(x, _WHOLE) and isinstance(y, (FloatType, DoubleType)):
            return next((t() for t in (type(y), DoubleType) if type(x) in _EXACT[t]), None)
        if isinstance(x, FloatType) and isinstance(y, DoubleType):
            return y
        if isinstance(x, DateType) and isinstance(y, TimestampNTZType):
            return y
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        return _decimal(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        inner = widened(a.elementType, b.elementType)
        return inner and ArrayType(inner)
    if isinstance(a, MapType) and isinstance(b, MapType):
        key, value = widened(a.keyType, b.keyType), widened(a.valueType, b.valueType)
        return MapType(key, value) if key and value else None
    if isinstance(a, StructType) and isinstance(b, StructType):
        merged, conflicts = merged_schema({"a": a, "b": b})
        return None if conflicts else merged
    return None


def _decimal(a: DecimalType, b: DecimalType) -> DecimalType | None:
    scale = max(a.scale, b.scale)
    whole = max(a.precision - a.scale, b.precision - b.scale)
    return DecimalType(whole + scale, scale) if whole + scale <= 38 else None


@dataclass(frozen=True)
class Conflict:
    """A column whose types do not go together, with the sources that have each."""

    column: str
    types: Mapping[str, tuple[str, ...]]

    def __str__(self) -> str:
        found = "; ".join(f"{kind} in {', '.join(sources)}" for kind, sources in self.types.items())
        return f"column {self.column}: {found}"


def merged_schema(schemas: Mapping[str, StructType], on_conflict: str = "fail") -> tuple[StructType, list[Conflict]]:
    """One schema for all sources, columns in the order they are first seen, and the conflicts left out of
    it; with ``on_conflict="string"`` a conflicting column is text instead."""
    kinds: dict[str, DataType | None] = {}
    seen: dict[str, dict[str, list[str]]] = {}
    for source, schema in schemas.items():
        for field in schema.fields:
            at = field.dataType
            seen.setdefault(field.name, {}).setdefault(at.simpleString(), []).append(source)
            known = kinds.get(field.name, NullType())
            kinds[field.name] = None if known is None else widened(known, at)
    fields, conflicts = [], []
    for name, kind in kinds.items():
        if kind is None:
            conflicts.append(Conflict(name, {k: tuple(v) for k, v in seen[name].items()}))
            if on_conflict == "string":
                fields.append(StructField(name, StringType()))
        else:
            fields.append(StructField(name, kind))
    return StructType(fields), [] if on_conflict == "string" else conflicts


@dataclass(frozen=True)
class Drift:
    """One change of a column, nested fields by path: ``added``, ``lost``, ``widened`` or ``changed``."""

    column: str
    change: str
    before: str | None
    after: str | None


def drift(before: StructType, after: StructType, prefix: str = "") -> list[Drift]:
    """What has changed between two schemas; the order of columns does not count."""
    old, new = ({f.name: f.dataType for f in s.fields} for s in (before, after))
    found: list[Drift] = []
    for name in dict.fromkeys([*old, *new]):
        a, b, path = old.get(name), new.get(name), f"{prefix}{name}"
        if a is None:
            found.append(Drift(path, "added", None, b.simpleString()))
        elif b is None:
            found.append(Drift(path, "lost", a.simpleString(), None))
        elif isinstance(a, StructType) and isinstance(b, StructType):
            found += drift(a, b, f"{path}.")
        elif a.simpleString() != b.simpleString():
            wider = widened(a, b)
            kind = "widened" if wider is not None and wider.simpleString() == b.simpleString() else "changed"
            found.append(Drift(path, kind, a.simpleString(), b.simpleString()))
    return found


def conformed(frame: DataFrame, schema: StructType) -> DataFrame:
    """``frame`` with the columns of a schema that is at least as wide; missing ones are NULL."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return frame.select(
        *[
            (_fit(quoted(f.name), kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def _fit(value, have: DataType, want: DataType):
    """A value in a wider type; a struct's fields are matched by name, as a cast would match them by place."""
    if have == want:
        return value
    if isinstance(have, StructType) and isinstance(want, StructType):
        kinds = {f.name: f.dataType for f in have.fields}
        inner = [
            (_fit(value.getField(f.name), kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(value, lambda x: _fit(x, have.elementType, want.elementType))
    if isinstance(want, StringType) and isinstance(have, (StructType, ArrayType, MapType)):
        return F.to_json(value)
    return value.cast(want)


def scan_drifting(
    spark: SparkSession,
    paths: Sequence[str],
    *,
    on_conflict: str = "fail",
    stored: str | None = None,
    format: str = "parquet",
) -> tuple[DataFrame, list[Drift]]:
    """Sources whose schemas differ as one relation, by name, in types that hold all of them, and what has
    changed since the schema that was ``stored`` last (a path; nothing is reported the first time).

    A conflict is an error that names the column and the sources, or, with ``"string"``, makes the column
    text. Only footers are read for the schemas. The stored schema is the merged one; a column that all
    sources have lost is reported once and then forgotten.
    """
    if on_conflict not in ("fail", "string"):
        raise ValueError(f"on_conflict must be fail or string, got {on_conflict!r}")
    if not paths:
        raise ValueError("no paths given")
    frames = {path: spark.read.format(format).load(path) for path in paths}
    schema, conflicts = merged_schema({p: f.schema for p, f in frames.items()}, on_conflict)
    if conflicts:
        raise ValueError("; ".join(map(str, conflicts)))
    changes: list[Drift] = []
    if stored:
        known = read_note(spark, stored)
        if known is not None:
            changes = drift(StructType.fromJson(known), schema)
        if known is None or changes:
            write_note(spark, stored, json.loads(schema.json()))
    return reduce(DataFrame.unionAll, [conformed(f, schema) for f in frames.values()]), changes
