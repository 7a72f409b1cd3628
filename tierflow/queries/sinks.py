"""Queries that write files or tables and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions import exact_sum, exact_sum_sql
from tierflow.operators import ensure_namespace, flatten_root, publish_table, write_files
from tierflow.plans import run_transform
from tierflow.queries.registry import query, table, table_path
from tierflow.session import scratch_path
from tierflow.sources import scan


@query("SELECT * FROM orders")
def write_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "overwrite")
    orders = table(spark, sf_dir, "orders")
    write_files(orders.withColumn("o_totalprice", F.lit(0.0)), path)
    write_files(orders, path)
    return scan(spark, path)


@query(
    """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
    """
)
def write_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "append")
    names = ("id", "name", "nation", "balance", "segment")
    write_files(table(spark, sf_dir, "customer").toDF(*names), path)
    suppliers = table(spark, sf_dir, "supplier").withColumn("segment", F.lit(None).cast("string")).toDF(*names)
    write_files(suppliers, path, "append")
    return scan(spark, path)


@query(
    """
    SELECT o_orderpriority AS priority, COUNT(*) AS order_count,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(1 AS BIGINT) AS file_count
    FROM orders GROUP BY o_orderpriority
    """
)
def write_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "single")
    report = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            exact_sum("o_totalprice").alias("total"),
        )
    )
    write_files(report, path, files=1)
    back = scan(spark, path)
    files = back.select(F.input_file_name().alias("f")).agg(F.count_distinct("f").alias("file_count"))
    return back.withColumn("file_count", files.scalar())


@query(
    """
    SELECT *, CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem
    """
)
def write_gold_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gold-layout")
    lines = table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    write_files(lines, path, partition_by=["ship_year"], sort_by=["l_suppkey", "l_shipdate"])
    return scan(spark, path)


def _fresh_table(spark: SparkSession, stem: str) -> tuple[str, str]:
    ensure_namespace(spark, "spark_catalog", "tierflow_checks")
    name = f"{stem}_{uuid.uuid4().hex[:12]}"
    return f"spark_catalog.tierflow_checks.{name}", scratch_path(spark, stem)


def _orders_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(*[c for c in orders.columns if c != "o_orderstatus"], "o_orderstatus")


@query("SELECT * FROM orders")
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh_table(spark, "appended")
    orders = _orders_by_status(spark, sf_dir)
    open_orders = F.col("o_orderstatus") == "O"
    publish_table(orders.filter(open_orders), name, "append", path=path)
    publish_table(orders.filter(~open_orders), name, "append", path=path)
    return spark.table(name)


@query(
    """
    SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders
    """
)
def table_overwrite_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh_table(spark, "partitions")
    orders = _orders_by_status(spark, sf_dir)
    parts = ["o_orderstatus"]
    publish_table(orders, name, "overwrite", partition_by=parts, path=path)
    closed = orders.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    publish_table(closed.select(*reversed(closed.columns)), name, "overwrite")
    return spark.table(name)


@query("SELECT *, year(o_orderdate) AS order_year FROM orders")
def table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh_table(spark, "replaced")
    publish_table(_orders_by_status(spark, sf_dir), name, "replace", path=path)
    orders = table(spark, sf_dir, "orders")
    other_shape = orders.withColumn("order_year", F.year("o_orderdate").cast("bigint"))
    publish_table(other_shape, name, "replace", path=path)
    return spark.table(name)


@query(
    """
    SELECT l_suppkey AS supplier_id, COUNT(*) AS line_count,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross
    FROM lineitem GROUP BY l_suppkey
    """
)
def transform_and_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, path = _fresh_table(spark, "published")
    run_transform(
        spark,
        f"""
        SELECT l_suppkey AS supplier_id, COUNT(*) AS line_count,
               {exact_sum_sql("l_extendedprice")} AS gross
        FROM source_data GROUP BY l_suppkey
        """,
        [table_path(sf_dir, "lineitem")],
        scratch_path(spark, "silver"),
        table=name,
        table_path=path,
    )
    return spark.table(name)


@query(
    """
    SELECT event_id AS id, ts, user_id AS actor_user, event_type AS actor_action, props AS raw,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k, value, CAST(NULL AS VARCHAR) AS note
    FROM events
    """
)
def jsonl_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    nested = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("action")).alias("actor"),
        F.col("props").alias("raw"),
        F.from_json("props", "k BIGINT").alias("props"),
        "value",
        F.lit(None).cast("string").alias("note"),
    )
    write_files(nested, path, format="json")
    schema = (
        "id BIGINT, ts TIMESTAMP_NTZ, actor STRUCT<user: BIGINT, action: STRING>, raw STRING, "
        "props STRUCT<k: BIGINT>, value DOUBLE, note STRING"
    )
    landed = scan(spark, path, "json", schema)
    return flatten_root(landed).drop("_corrupt_record")
