"""JSON lines of changing shape, sketches in gold rows, and runs that are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.operators import Distinct, Members, Quantiles, estimates, in_both, run_rows, sketch_gold, unite
from tierflow.plans import run_transform
from tierflow.queries.registry import query, table, table_path
from tierflow.session import scratch_path
from tierflow.sources import corrupt_lines, exploded, land_json, landed_rows, typed

# A number, a text, an object, or nothing, by the event; every twentieth line is cut short.
_JSON = """
    CASE event_id % 4
        WHEN 0 THEN '{"id":' || event_id || ',"v":' || (event_id % 97) || ',"tags":["' || event_type || '","t"]}'
        WHEN 1 THEN '{"id":' || event_id || ',"v":"' || (event_id % 97) || '","user":{"id":' || user_id || '}}'
        WHEN 2 THEN '{"id":' || event_id || ',"v":null,"user":{"id":"' || event_type || '"},"props":' || props || '}'
        ELSE '{"id":' || event_id || ',"items":[{"q":' || (event_id % 5) || '},{"q":2},{}],"user":' || user_id || '}'
    END
"""


def _landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "variant")
    lines = table(spark, sf_dir, "events").selectExpr(
        f"CASE WHEN event_id % 20 = 7 THEN left({_JSON}, 9) ELSE {_JSON} END AS value"
    )
    land_json(spark, lines, path)
    return path


@query(
    """
    SELECT event_id AS id,
           CASE WHEN event_id % 4 IN (0, 1) THEN CAST(event_id % 97 AS DOUBLE) END AS v,
           CASE event_id % 4 WHEN 0 THEN event_type || ',t' ELSE '' END AS tags,
           CASE WHEN event_id % 4 = 1 THEN user_id END AS user_id,
           CASE WHEN event_id % 4 = 2 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS k,
           CASE event_id % 4 WHEN 2 THEN 'user_id' ELSE '' END AS misfits
    FROM events WHERE event_id % 20 <> 7
    """
)
def jsonl_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several shapes, read by path with one type each."""
    fields = {
        "id": ("$.id", "bigint"),
        "v": ("$.v", "double"),
        "tags": ("$.tags", "array<string>"),
        "user_id": ("$.user.id", "bigint"),
        "k": ("$.props.k", "bigint"),
    }
    found = typed(landed_rows(spark, _landed(spark, sf_dir)), fields)
    return found.withColumn("tags", F.concat_ws(",", "tags")).select(*fields, F.concat_ws(",", "_misfits").alias("misfits"))


@query(
    """
    SELECT 'item' AS kind, event_id AS id, CAST(i AS INTEGER) AS place,
           CASE i WHEN 0 THEN event_id % 5 WHEN 1 THEN 2 END AS q
    FROM events, range(3) AS r(i) WHERE event_id % 4 = 3 AND event_id % 20 <> 7
    UNION ALL SELECT 'corrupt', NULL, NULL, COUNT(*) FROM events WHERE event_id % 20 = 7
    """
)
def jsonl_variant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a nested array, and the number of lines that did not parse."""
    path = _landed(spark, sf_dir)
    rows = exploded(landed_rows(spark, path), "$.items", "item")
    items = rows.select(
        F.lit("item").alias("kind"),
        F.try_variant_get("data", "$.id", "bigint").alias("id"),
        F.col("item_place").alias("place"),
        F.try_variant_get("item", "$.q", "bigint").alias("q"),
    )
    broken = corrupt_lines(spark, path).agg(F.count(F.lit(1)).alias("q"))
    empty = F.lit(None)
    rest = broken.select(F.lit("corrupt").alias("kind"), empty.cast("bigint").alias("id"), empty.cast("int").alias("place"), "q")
    return items.unionAll(rest)


_SKETCHES = {
    "parts": Distinct("l_partkey", 14),
    "suppliers": Members("l_suppkey", 14),
    "price": Quantiles("l_extendedprice"),
}


@query(
    """
    SELECT l_returnflag, date_trunc('quarter', l_shipdate) AS quarter, COUNT(*) AS line_count,
           true AS parts_close, true AS suppliers_close, true AS median_close
    FROM lineitem GROUP BY l_returnflag, date_trunc('quarter', l_shipdate)
    """
)
def gold_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts and medians of quarters from the sketches of days, held against the exact ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    path = scratch_path(spark, "sketches")
    counted = {"line_count": F.count(F.lit(1))}
    sketch_gold(lines, ["l_returnflag"], _SKETCHES, "day", "l_shipdate", counted).write.parquet(path)
    quarter = F.date_trunc("quarter", "period").cast("timestamp_ntz").alias("quarter")
    days = spark.read.parquet(path)
    united = unite(days, ["l_returnflag", quarter], _SKETCHES, {"line_count": F.sum("line_count")})
    found = estimates(united, _SKETCHES).withColumn("median", F.col("price")[0])
    its = [F.col("l_returnflag").alias("flag"), F.date_trunc("quarter", "l_shipdate").cast("timestamp_ntz").alias("q")]
    exact = lines.groupBy(*its).agg(
        F.count_distinct("l_partkey").alias("exact_parts"), F.count_distinct("l_suppkey").alias("exact_suppliers")
    )
    joined = found.join(exact, (F.col("l_returnflag") == F.col("flag")) & (F.col("quarter") == F.col("q")))
    # Share of the quarter's lines up to the estimated median, and below it.
    medians = found.select(F.col("l_returnflag").alias("f"), F.col("quarter").alias("p"), F.col("median").alias("m"))
    places = lines.join(
        F.broadcast(medians), (F.col("l_returnflag") == F.col("f")) & (F.date_trunc("quarter", "l_shipdate") == F.col("p"))
    ).groupBy("f", "p").agg(
        F.avg((F.col("l_extendedprice") <= F.col("m")).cast("int")).alias("upto"),
        F.avg((F.col("l_extendedprice") < F.col("m")).cast("int")).alias("below"),
    )
    joined = joined.join(places, (F.col("flag") == F.col("f")) & (F.col("q") == F.col("p")))
    close = lambda name: F.abs(F.col(name) - F.col(f"exact_{name}")) <= _SKETCHES[name].error * F.col(f"exact_{name}") + 1
    rank_error = _SKETCHES["price"].error
    return joined.select(
        "l_returnflag",
        "quarter",
        "line_count",
        close("parts").alias("parts_close"),
        close("suppliers").alias("suppliers_close"),
        # A rank is a whole row: one row either way.
        (
            (F.col("upto") >= 0.5 - rank_error - 1 / F.col("line_count"))
            & (F.col("below") <= 0.5 + rank_error + 1 / F.col("line_count"))
        ).alias("median_close"),
    )


@query(
    """
    WITH a AS (SELECT DISTINCT l_partkey AS k, l_returnflag AS f FROM lineitem WHERE year(l_shipdate) <= 1997),
    b AS (SELECT DISTINCT l_partkey AS k, l_returnflag AS f FROM lineitem WHERE year(l_shipdate) > 1997)
    SELECT a.f AS l_returnflag, true AS close FROM a JOIN b ON a.k = b.k AND a.f = b.f GROUP BY a.f
    """
)
def gold_sketch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were shipped both early and late, from the sketches of months."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_partkey")
    sketches = {"parts": Members("l_partkey", 14)}
    path = scratch_path(spark, "sketch-sets")
    sketch_gold(lines, ["l_returnflag"], sketches, "month", "l_shipdate").write.parquet(path)
    months = spark.read.parquet(path)
    early, late = (unite(months.filter(c), ["l_returnflag"], sketches) for c in (F.year("period") <= 1997, F.year("period") > 1997))
    both = early.withColumnRenamed("parts", "early").join(
        late.select(F.col("l_returnflag").alias("f"), F.col("parts").alias("late")), F.col("l_returnflag") == F.col("f")
    )
    guess = both.select("l_returnflag", in_both("early", "late").alias("guess"))
    halves = lines.groupBy("l_returnflag", "l_partkey").agg(F.count_distinct(F.year("l_shipdate") <= 1997).alias("n"))
    exact = halves.groupBy(F.col("l_returnflag").alias("f")).agg(F.count_if(F.col("n") == 2).alias("exact"), F.count(F.lit(1)).alias("all"))
    joined = guess.join(exact, F.col("l_returnflag") == F.col("f")).filter("exact > 0")
    bound = sketches["parts"].error * F.sqrt(F.col("exact") * F.col("all")) + 1
    return joined.select("l_returnflag", (F.abs(F.col("guess") - F.col("exact")) <= bound).alias("close"))


@query(
    """
    SELECT o_orderpriority AS priority, n, run_id FROM (
        SELECT o_orderpriority, COUNT(*) AS n, 'first' AS run_id FROM orders GROUP BY o_orderpriority
        UNION ALL
        SELECT o_orderpriority, COUNT(*), 'second' FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority)
    """
)
def append_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one destination, the first one called twice."""
    path = scratch_path(spark, "by-run")
    sql = "SELECT o_orderpriority AS priority, COUNT(*) AS n FROM source_data WHERE {} GROUP BY o_orderpriority"
    for run_id, which in (("first", "true"), ("second", "o_orderstatus = 'F'"), ("first", "true")):
        run_transform(
            spark, sql.format(which), [table_path(sf_dir, "orders")], path, mode="append", by_run=True, run_id=run_id
        )
    return run_rows(spark, path).withColumnRenamed("_run", "run_id")
