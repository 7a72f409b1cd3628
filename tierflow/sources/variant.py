"""JSON lines landed as they are, in a VARIANT column: no schema is inferred or asked for.

Each line is read and parsed once. Fields may change their type from line to line or be missing; they get
a type when they are read. Lines that do not parse are kept apart, whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, VariantType

from tierflow.functions.naming import quoted
from tierflow.operators.sinks import overlaps, source_folders

DATA = "data"
LINE = "_line"
SOURCE = "_source_file"
CORRUPT = "_corrupt"
MISFITS = "_misfits"

_LANDED = StructType(
    [
        StructField(DATA, VariantType()),
        StructField(LINE, StringType()),
        StructField(SOURCE, StringType()),
        StructField(CORRUPT, BooleanType()),
    ]
)


@dataclass(frozen=True)
class JsonLanding:
    rows: int
    corrupt: int


def land_json(spark: SparkSession, source: str | DataFrame, path: str, mode: str = "append", column: str = "value") -> JsonLanding:
    """Land JSON lines from a folder, or from the text ``column`` of a frame, below ``path``.

    Lines that parse become ``data``; the others, objects with a key given twice among them, go to a
    partition of their own with the whole line. Blank and NULL lines are left out. The lines are read once,
    by the one job that writes both and counts them.
    """
    lines = spark.read.text(source) if isinstance(source, str) else source.select(quoted(column).alias("value"))
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown write mode {mode!r}")
    if mode == "overwrite" and (clash := overlaps(path, source_folders(lines))):
        raise ValueError(f"refusing to overwrite {path}: it overlaps the source {clash}")
    parsed = lines.filter(F.trim("value") != "").select(
        F.try_parse_json("value").alias(DATA),
        F.col("value").alias(LINE),
        F.nullif(F.input_file_name(), F.lit("")).alias(SOURCE),
    )
    bad = F.col(DATA).isNull()
    counted = Observation()
    landed = parsed.select(DATA, F.when(bad, F.col(LINE)).alias(LINE), SOURCE, bad.alias(CORRUPT)).observe(
        counted, F.count(F.lit(1)).alias("n"), F.count_if(F.col(CORRUPT)).alias("bad")
    )
    landed.write.mode(mode).partitionBy(CORRUPT).parquet(path)
    return JsonLanding(counted.get["n"] - counted.get["bad"], counted.get["bad"])


def landed_rows(spark: SparkSession, path: str) -> DataFrame:
    """``data, _source_file`` of the lines that parsed; the others' files are not opened."""
    return spark.read.schema(_LANDED).parquet(path).filter(~F.col(CORRUPT)).select(DATA, SOURCE)


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """``_line, _source_file`` of the lines that did not parse."""
    return spark.read.schema(_LANDED).parquet(path).filter(CORRUPT).select(LINE, SOURCE)


def variant_schema(frame: DataFrame, column: str = DATA) -> str:
    """The type that fits all values, as text: ``OBJECT<…>``; a field of several kinds is ``VARIANT``."""
    return frame.agg(F.schema_of_variant_agg(quoted(column)).alias("s")).first().s


def typed(frame: DataFrame, fields: Mapping[str, tuple[str, str]], column: str = DATA) -> DataFrame:
    """``fields`` (name: path such as ``$.user.id``, and type) as columns in place of ``column``.

    A value that does not convert is NULL, and its name stands in ``_misfits``; a missing field or a JSON
    null is NULL without that. Nested arrays and objects may be asked for as ``array<…>``, ``struct<…>`` or
    ``variant``. Spark reads only the paths asked for.
    """
    values = {name: F.try_variant_get(quoted(column), path, kind) for name, (path, kind) in fields.items()}
    misfits = []
    for name, (path, _) in fields.items():
        there = F.try_variant_get(quoted(column), path, "variant")
        wrong = values[name].isNull() & there.isNotNull() & ~F.is_variant_null(there)
        misfits.append(F.when(wrong, F.lit(name)))
    others = [quoted(c) for c in frame.columns if c != column]
    listed = F.array_except(F.array(*misfits), F.array(F.lit(None).cast("string"))).alias(MISFITS)
    return frame.select(*others, *[v.alias(n) for n, v in values.items()], listed)


def exploded(frame: DataFrame, path: str, name: str, column: str = DATA) -> DataFrame:
    """A row per element of the array at ``path``: the element as a variant ``name``, and its place from 0 as
    ``<name>_place``. Rows without an array, or with an empty one, are left out."""
    new = [f"{name}_place", name]
    taken = [n for n in new if n.lower() in map(str.lower, frame.columns)]
    if taken:
        raise ValueError(f"columns {taken} are there already")
    elements = F.try_variant_get(quoted(column), path, "array<variant>")
    return frame.select("*", F.posexplode(elements).alias(*new))
