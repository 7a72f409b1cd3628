"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tierflow.plans.transform import transform_sql
from tierflow.sources.files import scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, table_path(sf_dir, name))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, by default under its function's name, with the SQL that must give the same
    rows."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return add


def sql_query(
    name: str,
    tables: list[str],
    text: str,
    oracle: str | None,
    prepare: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> None:
    """Register a SQL text that runs over named tables, each optionally prepared first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = {t: table(spark, sf_dir, t) for t in tables}
        for view, change in (prepare or {}).items():
            sources[view] = change(sources[view])
        return transform_sql(spark, sources, text)

    query(oracle, name)(run)
