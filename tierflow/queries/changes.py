"""Folders that change: merged batches, recomputed periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions import exact_sum
from tierflow.operators import scan_drifting, upsert, upserted_rows, write_clustered
from tierflow.plans import gold_rows, load_periods, refresh_gold
from tierflow.queries.registry import query, table
from tierflow.session import scratch_path


@query(
    """
    SELECT user_id, event_id, ts, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n = 1 AND event_type <> 'error'
    """
)
def silver_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, gone if it is an error. The later half of time comes first."""
    path = scratch_path(spark, "silver-upsert")
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    middle = events.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("bigint"))).scalar()
    for name, half in (("late", F.col("ts") > middle), ("early", F.col("ts") <= middle)):
        upsert(
            events.filter(half),
            path,
            ["user_id"],
            ["ts", "event_id"],
            change_id=name,
            deleted=F.col("event_type") == "error",
            buckets=16,
        )
    return upserted_rows(spark, path)


@query(
    """
    SELECT l_returnflag, date_trunc('month', l_shipdate) AS period, COUNT(*) AS line_count,
           COUNT(DISTINCT l_suppkey) AS suppliers,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
    FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate)
    """
)
def gold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads: lines up to 1997, later ones, and late ones of one month in both."""
    silver, gold = scratch_path(spark, "silver-loads"), scratch_path(spark, "gold-periods")
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_extendedprice", "l_shipdate")
    late = (F.month("l_shipdate") == 6) & (F.col("l_suppkey") % 5 == 0)
    early = F.year("l_shipdate") <= 1997
    measures = {
        "line_count": F.count(F.lit(1)),
        "suppliers": F.count_distinct("l_suppkey"),
        "price": exact_sum("l_extendedprice"),
    }
    for name, rows in (("first", early & ~late), ("second", ~early & ~late), ("late", late)):
        load_periods(lines.filter(rows), silver, name, "l_shipdate")
        refresh_gold(spark, silver, lines.schema, gold, ["l_returnflag"], measures, "l_shipdate")
    return gold_rows(spark, gold)


@query(
    """
    SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice,
           CASE o_orderstatus WHEN 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
           CASE o_orderstatus WHEN 'P' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE o_orderdate END AS o_orderdate
    FROM orders
    """
)
def scan_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads of the orders: narrower keys, a column less, dates in place of times."""
    root = scratch_path(spark, "drift")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_orderstatus")
    load = {s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in "FOP"}
    load["F"].drop("o_orderpriority").write.parquet(f"{root}/f")
    load["O"].withColumn("o_custkey", F.col("o_custkey").cast("int")).write.parquet(f"{root}/o")
    load["P"].withColumn("o_orderdate", F.col("o_orderdate").cast("date")).write.parquet(f"{root}/p")
    frame, _ = scan_drifting(spark, [f"{root}/o", f"{root}/f", f"{root}/p"])
    return frame.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_extendedprice > 20000
    """
)
def write_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, clustered by date and price, read with a filter on both."""
    path = scratch_path(spark, "clustered")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    write_clustered(lines, path, ["l_shipdate", "l_extendedprice"], files=32)
    rows = spark.read.parquet(path)
    years = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.filter(years & (F.col("l_extendedprice") > 20000))
