"""Queries over the bronze, silver and gold operators and over streaming ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions import exact_avg, exact_sum
from tierflow.operators import (
    ForeignKey,
    InRange,
    InSet,
    Matches,
    NotNull,
    Unique,
    check_quality,
    clean,
    dedup_exact,
    dedup_latest,
    gold_aggregate,
    split_quality,
    standardize,
    write_quality,
)
from tierflow.plans import Step, ingest, land_bronze, run_layers
from tierflow.queries.registry import query, table, table_path
from tierflow.session import scratch_path
from tierflow.sources import scan, scan_all
from tierflow.streaming import dedup_stream, ingest_stream, merge_stream, merged_rows, stream_files


def _late_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from 1996 on: against these, some lines have no order."""
    return table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'")


def _line_rules(spark: SparkSession, sf_dir: str) -> list:
    return [
        NotNull("ship_date_present", "l_shipdate"),
        InRange("quantity_in_range", "l_quantity", 1.0, 45.0),
        InSet("flag_known", "l_returnflag", ("A", "N")),
        Matches("status_pattern", "l_linestatus", "^[OF]$"),
        Unique("line_unique", ("l_orderkey", "l_linenumber")),
        ForeignKey("order_known", "l_orderkey", _late_orders(spark, sf_dir), "o_orderkey"),
    ]


@query(
    """
    WITH n AS (SELECT COUNT(*) AS c FROM lineitem),
    late AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
    dup AS (SELECT COUNT(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
    SELECT 'ship_date_present' AS rule, (SELECT c FROM n) AS checked,
           (SELECT COUNT(*) FROM lineitem WHERE l_shipdate IS NULL) AS failed
    UNION ALL SELECT 'quantity_in_range', (SELECT c FROM n),
           (SELECT COUNT(*) FROM lineitem WHERE l_quantity < 1 OR l_quantity > 45)
    UNION ALL SELECT 'flag_known', (SELECT c FROM n),
           (SELECT COUNT(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N'))
    UNION ALL SELECT 'status_pattern', (SELECT c FROM n),
           (SELECT COUNT(*) FROM lineitem WHERE l_linestatus NOT IN ('O', 'F'))
    UNION ALL SELECT 'line_unique', (SELECT c FROM n), (SELECT CAST(SUM(k) AS BIGINT) FROM dup)
    UNION ALL SELECT 'order_known', (SELECT c FROM n),
           (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM late))
    """
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_quality(table(spark, sf_dir, "lineitem"), _line_rules(spark, sf_dir))


@query(
    """
    WITH k AS (SELECT l_orderkey AS ok, l_linenumber AS ln, COUNT(*) AS n
               FROM lineitem GROUP BY l_orderkey, l_linenumber),
    late AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
    flagged AS (
        SELECT l.*, concat_ws(',',
            CASE WHEN l_quantity < 1 OR l_quantity > 45 THEN 'quantity_in_range' END,
            CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_known' END,
            CASE WHEN k.n > 1 THEN 'line_unique' END,
            CASE WHEN late.o_orderkey IS NULL THEN 'order_known' END) AS failed_rules
        FROM lineitem l JOIN k ON l_orderkey = ok AND l_linenumber = ln
        LEFT JOIN late ON l_orderkey = o_orderkey
    )
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, failed_rules
    FROM flagged WHERE failed_rules <> ''
    """
)
def quality_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, quarantined = split_quality(
        table(spark, sf_dir, "lineitem"), _line_rules(spark, sf_dir)
    )
    return quarantined.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_quantity",
        F.concat_ws(",", "_failed_rules").alias("failed_rules"),
    )


@query(
    """
    SELECT COUNT(*) AS passed, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
           l_returnflag AS flag
    FROM lineitem l
    WHERE l_quantity BETWEEN 1 AND 45 AND l_returnflag IN ('A', 'N')
      AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
      AND NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey AS ok, l_linenumber AS ln FROM lineitem
                                     GROUP BY 1, 2 HAVING COUNT(*) > 1)
                      WHERE ok = l_orderkey AND ln = l_linenumber)
    GROUP BY l_returnflag
    """
)
def quality_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, path = table(spark, sf_dir, "lineitem"), scratch_path(spark, "quality")
    passed, _ = write_quality(lines, _line_rules(spark, sf_dir), path)
    return passed.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("passed"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )


@query(
    """
    SELECT c_custkey AS customer_id, TRY_CAST(replace(c_name, 'Customer#', '') AS INTEGER) AS name,
           TRY_CAST(c_mktsegment AS INTEGER) AS segment, CAST(c_nationkey AS VARCHAR) AS nation,
           CAST(NULL AS DOUBLE) AS credit_limit
    FROM customer
    """,
    name="standardize",
)
def standardize_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("Nation"),
        F.col("c_custkey").alias("Customer ID"),
        F.regexp_replace("c_name", "Customer#", "").alias("-name-"),
        F.col("c_mktsegment").alias("SEGMENT"),
        "c_acctbal",
    )
    schema = "customer_id BIGINT, name INT, segment INT, nation STRING, credit_limit DOUBLE"
    return standardize(raw, schema)


@query(
    """
    WITH padded AS (
        SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS id,
               CASE c_custkey % 7 WHEN 0 THEN '   ' WHEN 1 THEN '' ELSE '  ' || c_name || ' ' END AS name,
               CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS segment
        FROM customer
    )
    SELECT id, nullif(trim(name), '') AS name, nullif(trim(segment), '') AS segment FROM padded
    WHERE id IS NOT NULL OR nullif(trim(name), '') IS NOT NULL OR nullif(trim(segment), '') IS NOT NULL
    """,
    name="clean",
)
def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey END AS id",
        "CASE c_custkey % 7 WHEN 0 THEN '   ' WHEN 1 THEN '' ELSE '  ' || c_name || ' ' END AS name",
        "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE c_mktsegment END AS segment",
    )
    return clean(padded)


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem
    ) WHERE rn = 1
    """,
    name="dedup_latest",
)
def dedup_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]
    return dedup_latest(lines, ["l_orderkey", "l_linenumber"], order)


@query("SELECT DISTINCT text, lang FROM documents", name="dedup_exact")
def dedup_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents").select("text", "lang"))


@query("SELECT event_id, ts, user_id, event_type, value, props, 'run-1' AS run_id, true AS has_file FROM events")
def bronze_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bronze")
    land_bronze(table(spark, sf_dir, "events"), path, "run-1")
    return scan(spark, path).select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        "props",
        F.col("_run_id").alias("run_id"),
        (F.col("_source_file").isNotNull() & F.col("_ingested_at").isNotNull()).alias("has_file"),
    )


@query("SELECT * FROM events")
def ingest_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "landing")
    events = table(spark, sf_dir, "events")
    ingest(events, path, "run-1", metadata=False)
    return scan(spark, path, "json", events.schema, mode="FAILFAST")


@query(
    """
    SELECT o_custkey AS customer_id, COUNT(*) AS order_count,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS average,
           MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order
    FROM orders GROUP BY o_custkey
    """
)
def gold_customer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer_id")
    return gold_aggregate(
        orders,
        ["customer_id"],
        {
            "order_count": F.count(F.lit(1)),
            "total": exact_sum("o_totalprice"),
            "average": exact_avg("o_totalprice"),
            "first_order": F.min("o_orderdate"),
            "last_order": F.max("o_orderdate"),
        },
    )


@query(
    """
    SELECT l_returnflag, date_trunc('month', l_shipdate) AS period, COUNT(*) AS line_count,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)))
                AS DOUBLE) AS revenue
    FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate)
    """
)
def gold_monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return gold_aggregate(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        {
            "line_count": F.count(F.lit(1)),
            "revenue": exact_sum(revenue, scale=4),
        },
        grain="month",
        ts="l_shipdate",
    )


@query(
    """
    WITH silver AS (
        SELECT * FROM (
            SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
                   ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                       ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) AS rn
            FROM lineitem WHERE l_quantity BETWEEN 1 AND 45
        ) WHERE rn = 1
    ), per_order AS (
        SELECT l_orderkey, SUM(price) AS price, COUNT(*) AS n FROM silver GROUP BY l_orderkey
    )
    SELECT c_mktsegment AS segment, date_trunc('year', o_orderdate) AS period,
           CAST(SUM(price) AS DOUBLE) AS revenue, CAST(SUM(n) AS BIGINT) AS line_count
    FROM per_order JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment, date_trunc('year', o_orderdate)
    """
)
def medallion_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {name: table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}

    def silver_lines(inputs) -> DataFrame:
        valid, _ = split_quality(
            inputs["bronze_lines"], [InRange("quantity_in_range", "l_quantity", 1.0, 45.0)]
        )
        order = [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice"]
        return dedup_latest(valid, ["l_orderkey", "l_linenumber"], order)

    # Lines shrink to one row per order, then to one per customer and year, before each join. Prices
    # are added in cents.
    segment_revenue = """
        WITH per_order AS (
            SELECT l_orderkey, SUM(CAST(rint(l_extendedprice * 100) AS BIGINT)) AS cents, COUNT(*) AS n
            FROM silver_lines GROUP BY l_orderkey
        ), per_customer AS (
            SELECT o_custkey, CAST(date_trunc('YEAR', o_orderdate) AS TIMESTAMP_NTZ) AS period,
                   SUM(cents) AS cents, SUM(n) AS n
            FROM per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
        )
        SELECT c_mktsegment AS segment, period, CAST(SUM(cents) AS DOUBLE) / 100 AS revenue,
               SUM(n) AS line_count
        FROM per_customer JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, period
    """
    steps = [
        Step("bronze_lines", "bronze", ["lineitem"], "SELECT * FROM lineitem"),
        Step("silver_lines", "silver", ["bronze_lines"], silver_lines),
        Step("segment_revenue", "gold", ["silver_lines", "orders", "customer"], segment_revenue),
    ]
    return run_layers(spark, scratch_path(spark, "chain"), sources, steps)["segment_revenue"]


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return stream_files(spark, table_path(sf_dir, "events"), schema)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def ingest_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stream")
    ingest_stream(_event_stream(spark, sf_dir), f"{root}/out", f"{root}/progress").awaitTermination()
    return scan(spark, f"{root}/out")


@query("SELECT DISTINCT * FROM events")
def ingest_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later events come first, and again in the second batch together with all earlier ones."""
    root = scratch_path(spark, "stream-late")
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("bigint"))).scalar()
    for batch in (events.filter(F.col("ts") > middle), events):
        batch.write.mode("append").parquet(f"{root}/in")
        stream = stream_files(spark, f"{root}/in", events.schema)
        merge_stream(stream, f"{root}/out", f"{root}/progress", ["event_id"], "ts").awaitTermination()
    return merged_rows(spark, f"{root}/out", events.schema)


@query("SELECT *, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS score FROM events")
def bronze_merged_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of an archive, the second with a column more."""
    path = scratch_path(spark, "bronze-merged")
    events = table(spark, sf_dir, "events")
    land_bronze(events.filter("event_type = 'click'"), path, "run-1")
    land_bronze(events.filter("event_type <> 'click'").withColumn("score", F.col("value")), path, "run-2")
    frame, _ = scan_all(spark, [path], mergeSchema="true")
    return frame.select(*events.columns, "score")


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def ingest_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every event arrives twice.
    root = scratch_path(spark, "stream-dedup")
    twice = _event_stream(spark, sf_dir).union(_event_stream(spark, sf_dir))
    unique = dedup_stream(twice, ["event_id"], "ts", "1 hour")
    ingest_stream(unique, f"{root}/out", f"{root}/progress").awaitTermination()
    return scan(spark, f"{root}/out").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value"
    )
