"""Queries over sources, unions, SQL texts, names and row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions import exact_sum_sql, normalize_path_col, sanitize_col, target_table_col
from tierflow.operators import combine, preview, row_counts, write_files
from tierflow.plans import transform_sql
from tierflow.queries.registry import query, table, table_path
from tierflow.session import scratch_path
from tierflow.sources import scan_all


def customer_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``customer_id, amount``, the amount exact so that sums do not depend on order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


@query(
    """
    SELECT o_custkey AS customer_id,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
           COUNT(*) AS order_count
    FROM orders GROUP BY o_custkey
    """
)
def sql_spend_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_sql(
        spark,
        customer_amounts(spark, sf_dir),
        """
        SELECT customer_id, CAST(SUM(amount) AS DOUBLE) AS total_spent, COUNT(*) AS order_count
        FROM source_data GROUP BY customer_id
        """,
    )


@query(
    """
    SELECT o_custkey AS customer_id,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
    FROM orders GROUP BY o_custkey
    """
)
def sql_total_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_sql(
        spark,
        customer_amounts(spark, sf_dir),
        """
        SELECT customer_id, CAST(SUM(amount) AS DOUBLE) AS total_amount
        FROM source_data GROUP BY customer_id
        """,
    )


@query(
    """
    SELECT c_custkey AS customer_id, c_name AS name, COALESCE(order_count, 0) AS order_count,
           COALESCE(total_spent, 0.0) AS total_spent
    FROM customer LEFT JOIN (
        SELECT o_custkey, COUNT(*) AS order_count,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spent
        FROM orders GROUP BY o_custkey
    ) s ON c_custkey = o_custkey
    """
)
def sql_named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders shrink to one row per customer before they meet the customers.
    return transform_sql(
        spark,
        {name: table_path(sf_dir, name) for name in ("orders", "customer")},
        f"""
        SELECT c_custkey AS customer_id, c_name AS name, COALESCE(order_count, 0) AS order_count,
               COALESCE(total_spent, 0D) AS total_spent
        FROM customer LEFT JOIN (
            SELECT o_custkey, COUNT(*) AS order_count,
                   {exact_sum_sql("o_totalprice")} AS total_spent
            FROM orders GROUP BY o_custkey
        ) s ON c_custkey = o_custkey
        """,
    )


@query(
    """
    SELECT l_suppkey AS supplier_id, l_returnflag AS flag,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS gross,
           COUNT(*) AS line_count
    FROM lineitem GROUP BY l_suppkey, l_returnflag
    """
)
def sql_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_sql(
        spark,
        table(spark, sf_dir, "lineitem"),
        """
        -- two statements; this ';' and the one in the text below separate nothing
        CREATE OR REPLACE TEMPORARY VIEW priced_lines AS
        SELECT l_suppkey AS supplier_id, l_returnflag AS flag, 'a;b' AS tag,
               CAST(rint(l_extendedprice * 100) AS BIGINT) AS cents
        FROM source_data;
        SELECT supplier_id, flag, CAST(SUM(cents) AS DOUBLE) / 100 AS gross, COUNT(*) AS line_count
        FROM priced_lines WHERE tag = 'a;b' GROUP BY supplier_id, flag;
        """,
    )


@query(
    """
    SELECT o_orderpriority AS priority, COUNT(*) AS order_count,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_totalprice >= 1000.0 AND o_orderstatus = 'O' GROUP BY o_orderpriority
    """
)
def sql_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_sql(
        spark,
        {"orders": table_path(sf_dir, "orders")},
        f"""
        SELECT o_orderpriority AS priority, COUNT(*) AS order_count,
               {exact_sum_sql("o_totalprice")} AS total
        FROM orders WHERE o_totalprice >= :low AND o_orderstatus = :status GROUP BY o_orderpriority
        """,
        params={"low": 1000.0, "status": "O"},
    )


@query("SELECT * FROM orders")
def scan_skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = scratch_path(spark, "missing")
    combined, _ = scan_all(spark, [missing, table_path(sf_dir, "orders")])
    return combined


@query("SELECT * FROM orders")
def scan_skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The empty source has another schema: it must be gone before the union.
    empty = scratch_path(spark, "empty")
    write_files(table(spark, sf_dir, "customer").filter(F.lit(False)), empty)
    combined, _ = scan_all(spark, [empty, table_path(sf_dir, "orders")], skip_empty=True)
    return combined


@query(
    """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
    """
)
def union_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["id", "name", "nation_id", "balance"]
    customers = table(spark, sf_dir, "customer").drop("c_mktsegment").toDF(*columns)
    suppliers = table(spark, sf_dir, "supplier").toDF(*columns)
    return combine([customers, suppliers])


@query(
    """
    SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS segment,
           CAST(NULL AS DOUBLE) AS balance
    FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, s_acctbal FROM supplier
    """
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation_id", "c_mktsegment AS segment"
    )
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal AS balance", "s_nationkey AS nation_id", "s_name AS name", "s_suppkey AS id"
    )
    return combine([customers, suppliers], by="name")


COUNTED = ("nation", "region", "customer", "orders", "lineitem", "events", "documents")


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS source, COUNT(*) AS row_count FROM {t}" for t in COUNTED),
    name="row_counts",
)
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts({name: table(spark, sf_dir, name) for name in COUNTED})


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def preview_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "orders"), 10, [F.desc("o_totalprice"), "o_orderkey"])


@query(
    """
    WITH paths AS (
        SELECT page_id, CASE page_id % 3
            WHEN 0 THEN 'S3A://' || regexp_replace(url, '^https?://', '') || '/'
            WHEN 1 THEN 's3://' || regexp_replace(url, '^https?://[^/]*/', '')
            ELSE 'bucket' END AS path
        FROM pages
    ), parts AS (
        SELECT page_id, path,
               string_split(rtrim(regexp_replace(path, '^s3a?://', '', 'i'), '/'), '/') AS p
        FROM paths
    ), named AS (
        SELECT page_id, path, CASE WHEN len(p) > 1 THEN p[-2] ELSE 'raw' END AS ns,
               CASE WHEN len(p) > 1 THEN p[-1] ELSE 'table' END AS tb FROM parts
    ), safe AS (
        SELECT page_id, path, ns, tb,
               trim(regexp_replace(regexp_replace(lower(ns), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS n,
               trim(regexp_replace(regexp_replace(lower(tb), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS t
        FROM named
    )
    SELECT page_id, path, 'lake.' ||
           CASE WHEN ns = '' THEN '' WHEN n = '' THEN 'x' WHEN n SIMILAR TO '[0-9].*' THEN 't' || n ELSE n END
           || '.' ||
           CASE WHEN tb = '' THEN '' WHEN t = '' THEN 'x' WHEN t SIMILAR TO '[0-9].*' THEN 't' || t ELSE t END
           AS table_name
    FROM safe
    """
)
def target_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    path = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("S3A://"), bare, F.lit("/")))
        .when(
            F.col("page_id") % 3 == 1,
            F.concat(F.lit("s3://"), F.regexp_replace("url", "^https?://[^/]*/", "")),
        )
        .otherwise(F.lit("bucket"))
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", path.alias("path"))
        .withColumn("table_name", target_table_col("path", "lake"))
    )


@query(
    """
    WITH s AS (
        SELECT p_partkey, p_size || '. ' || p_type || ' / ' || p_name AS raw FROM part
        UNION ALL SELECT p_partkey, '--' AS raw FROM part
        UNION ALL SELECT p_partkey, p_type AS raw FROM part
    ), c AS (
        SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_]', '_', 'g'),
                                      '_+', '_', 'g'), '_') AS n FROM s
    )
    SELECT p_partkey, raw,
           CASE WHEN n = '' THEN 'x' WHEN n SIMILAR TO '[0-9].*' THEN 't' || n ELSE n END AS name
    FROM c
    """
)
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    numbered = F.concat(F.col("p_size"), F.lit(". "), "p_type", F.lit(" / "), "p_name")
    raw = F.explode(F.array(numbered, F.lit("--"), F.col("p_type"))).alias("raw")
    return part.select("p_partkey", raw).withColumn("name", sanitize_col("raw"))


@query(
    """
    WITH paths AS (
        SELECT page_id, CASE page_id % 5
            WHEN 0 THEN 's3://' || regexp_replace(url, '^https?://', '')
            WHEN 1 THEN 's3a://' || regexp_replace(url, '^https?://', '')
            WHEN 2 THEN '/' || regexp_replace(url, '^https?://', '')
            WHEN 3 THEN url
            ELSE regexp_replace(url, '^https?://', '') END AS path
        FROM pages
    )
    SELECT page_id, path, CASE
        WHEN path LIKE 's3://%' THEN 's3a://' || substr(path, 6)
        WHEN path LIKE 's3a://%' OR path LIKE '/%' OR path LIKE 'http%' THEN path
        ELSE 's3a://' || path END AS location
    FROM paths
    """
)
def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare, kind = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("s3://"), bare))
        .when(kind == 1, F.concat(F.lit("s3a://"), bare))
        .when(kind == 2, F.concat(F.lit("/"), bare))
        .when(kind == 3, F.col("url"))
        .otherwise(bare)
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", path.alias("path"))
        .withColumn("location", normalize_path_col("path"))
    )
