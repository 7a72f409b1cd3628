"""Side-by-side comparison of a Spark result with DuckDB over the same files."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return repr(value)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, connection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result; empty when nothing does."""
    relation = connection.sql(sql)
    spark_types = dict(frame.dtypes)
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    found = []
    if set(spark_types) != set(duck_types):
        return [f"columns {sorted(spark_types)} against {sorted(duck_types)}"]
    for name, kind in spark_types.items():
        if KINDS.get(kind, kind) != duck_types[name]:
            found.append(f"type of {name}: {kind} against {duck_types[name]}")
    mine = _rows(frame.columns, frame.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows against {len(theirs)}")
    if mine != theirs:
        only_mine = sorted(set(mine) - set(theirs))[:3]
        only_theirs = sorted(set(theirs) - set(mine))[:3]
        found.append(f"values: {only_mine} against {only_theirs}")
    return found
