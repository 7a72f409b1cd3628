"""Relational categories, each as one SQL text over the standard tables.

The texts follow the rules that keep such queries fast on skewed data: facts are aggregated to their
join key before a join, key lists are made distinct before a semi or anti join, and windows run over
aggregated rows whose number per partition depends on the calendar, not on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.functions import exact_sum_sql
from tierflow.operators import broadcast_if_small
from tierflow.plans import transform_sql
from tierflow.queries.registry import query, sql_query, table, table_path

sql_query(
    "p_project_case",
    ["part"],
    """
    SELECT p_partkey, upper(p_brand) AS brand, p_retailprice * 2 AS double_price,
           CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket,
           CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS is_economy
    FROM part
    """,
    """
    SELECT p_partkey, upper(p_brand) AS brand, p_retailprice * 2 AS double_price,
           CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket,
           CASE p_type WHEN 'ECONOMY' THEN 1 ELSE 0 END AS is_economy
    FROM part
    """,
)

sql_query(
    "p_filter_predicates",
    ["lineitem"],
    """
    SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'
      AND l_returnflag RLIKE '^[AR]$' AND l_shipdate IS NOT NULL
      AND l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' AND NOT l_discount > 0.08
    """,
    """
    SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem
    WHERE l_quantity BETWEEN 5 AND 40 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'
      AND regexp_matches(l_returnflag, '^[AR]$') AND l_shipdate IS NOT NULL
      AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND NOT l_discount > 0.08
    """,
)

sql_query(
    "p_join_inner",
    ["lineitem", "orders"],
    """
    SELECT o_orderpriority AS priority, COUNT(*) AS order_count, SUM(n) AS line_count,
           CAST(SUM(cents) AS DOUBLE) / 100 AS revenue
    FROM (
        SELECT l_orderkey, COUNT(*) AS n, SUM(CAST(rint(l_extendedprice * 100) AS BIGINT)) AS cents
        FROM lineitem GROUP BY l_orderkey
    ) l JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_orderpriority
    """,
    """
    SELECT o_orderpriority AS priority, COUNT(DISTINCT o_orderkey) AS order_count,
           COUNT(*) AS line_count,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority
    """,
)


@query(
    """
    SELECT c_custkey, c_name, n_name AS nation, r_name AS region
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """
)
def p_join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The hint is set on a view only if its estimated size is within a bound.
    small = {name: broadcast_if_small(table(spark, sf_dir, name)) for name in ("nation", "region")}
    return transform_sql(
        spark,
        {"customer": table_path(sf_dir, "customer"), **small},
        """
        SELECT c_custkey, c_name, n_name AS nation, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        """,
    )


sql_query(
    "p_join_outer",
    ["customer", "orders", "supplier"],
    """
    WITH spend AS (
        SELECT o_custkey, COUNT(*) AS n FROM orders
        WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' GROUP BY o_custkey
    )
    SELECT 'left' AS kind, c_custkey AS a, o_custkey AS b, n FROM customer LEFT JOIN spend ON c_custkey = o_custkey
    UNION ALL
    SELECT 'right', o_custkey, c_custkey, n FROM spend RIGHT JOIN customer ON c_custkey = o_custkey
    UNION ALL
    SELECT 'full', c_custkey, s_suppkey, NULL
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20
    """,
    """
    WITH spend AS (
        SELECT o_custkey, COUNT(*) AS n FROM orders
        WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey
    )
    SELECT 'left' AS kind, c_custkey AS a, o_custkey AS b, n FROM customer LEFT JOIN spend ON c_custkey = o_custkey
    UNION ALL
    SELECT 'right', o_custkey, c_custkey, n FROM spend RIGHT JOIN customer ON c_custkey = o_custkey
    UNION ALL
    SELECT 'full', c_custkey, s_suppkey, NULL
    FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 20
    """,
)

sql_query(
    "p_join_semi_anti",
    ["customer", "orders", "documents", "labels"],
    """
    WITH urgent AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
    marks AS (SELECT doc_id, MAX(quality) AS quality, MAX(toxic) AS toxic FROM labels GROUP BY doc_id)
    SELECT 'semi' AS kind, c_custkey AS id FROM customer LEFT SEMI JOIN urgent ON c_custkey = o_custkey
    UNION ALL SELECT 'anti', c_custkey FROM customer LEFT ANTI JOIN urgent ON c_custkey = o_custkey
    UNION ALL SELECT 'exists', doc_id FROM documents d
        WHERE EXISTS (SELECT 1 FROM marks l WHERE l.doc_id = d.doc_id AND l.quality = 1)
    UNION ALL SELECT 'not exists', doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM marks l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'in', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM marks WHERE toxic = 1)
    """,
    """
    WITH urgent AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT 'semi' AS kind, c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM urgent)
    UNION ALL SELECT 'anti', c_custkey FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM urgent WHERE o_custkey = c_custkey)
    UNION ALL SELECT 'exists', doc_id FROM documents d
        WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
    UNION ALL SELECT 'not exists', doc_id FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'in', doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    """,
)

# Lines are counted per order and ship date first: one row per day and order meets the order.
_JOIN_RANGE = """
    SELECT o_orderpriority AS priority, COUNT(*) AS day_count, CAST(SUM(n) AS BIGINT) AS line_count
    FROM (SELECT l_orderkey, l_shipdate, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_shipdate) l
    JOIN orders ON l_orderkey = o_orderkey
     AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '1000' DAY
    GROUP BY o_orderpriority
"""
sql_query("p_join_range", ["lineitem", "orders"], _JOIN_RANGE, _JOIN_RANGE)

# Every nation with every priority that occurs, also where no order exists. The priorities are
# gathered into one array by an aggregate and dealt out by a generator, so no join makes the product.
sql_query(
    "p_join_cross",
    ["nation", "customer", "orders"],
    """
    WITH grid AS (
        SELECT n_nationkey, n_name, priority FROM nation
        LATERAL VIEW explode((SELECT collect_set(o_orderpriority) FROM orders)) p AS priority
    ), per_customer AS (
        SELECT o_custkey, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority
    ), per_nation AS (
        SELECT c_nationkey, o_orderpriority, SUM(n) AS n
        FROM per_customer JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority
    )
    SELECT n_name AS nation, priority, COALESCE(n, 0) AS order_count
    FROM grid LEFT JOIN per_nation ON n_nationkey = c_nationkey AND priority = o_orderpriority
    """,
    """
    SELECT n_name AS nation, priority, COALESCE(n, 0) AS order_count
    FROM (SELECT * FROM nation,
            (SELECT DISTINCT o_orderpriority AS priority FROM orders WHERE o_orderpriority IS NOT NULL)) grid
    LEFT JOIN (SELECT c_nationkey, o_orderpriority, COUNT(*) AS n
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) f
      ON n_nationkey = c_nationkey AND priority = o_orderpriority
    """,
)

_AGG_BASIC = """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS row_count, {quantity} AS quantity, {price} AS price,
           ({discount}) / COUNT(l_discount) AS avg_discount, MIN(l_shipdate) AS first_ship,
           MAX(l_extendedprice) AS top_price, round(stddev_samp(l_quantity), 6) AS quantity_stddev
    FROM lineitem GROUP BY l_returnflag, l_linestatus
"""
_SUMMED = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
sql_query(
    "p_agg_basic",
    ["lineitem"],
    _AGG_BASIC.format(**{name: exact_sum_sql(column) for name, column in _SUMMED.items()}),
    _AGG_BASIC.format(
        **{n: f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)" for n, c in _SUMMED.items()}
    ),
)

_AGG_DISTINCT = """
    SELECT l_returnflag AS flag, CAST(NULL AS VARCHAR(1)) AS status, COUNT(DISTINCT l_suppkey) AS suppliers,
           COUNT(DISTINCT l_partkey) AS parts, COUNT(l_orderkey) AS line_count
    FROM lineitem GROUP BY l_returnflag
    UNION ALL
    SELECT DISTINCT l_returnflag, l_linestatus, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
           CAST(NULL AS BIGINT)
    FROM lineitem
"""
sql_query("p_agg_distinct", ["lineitem"], _AGG_DISTINCT, _AGG_DISTINCT)

# The sets are formed over counts per finest group, so rows are not multiplied by the sets.
sql_query(
    "p_agg_grouping_sets",
    ["lineitem"],
    """
    WITH finest AS (
        SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2
    )
    SELECT 'sets' AS kind, a, b, CAST(grouping(a) AS BIGINT) AS ga, SUM(n) AS n
    FROM finest GROUP BY GROUPING SETS ((a, b), (b), ())
    UNION ALL
    SELECT 'rollup', a, b, CAST(grouping(a) AS BIGINT), SUM(n) FROM finest GROUP BY ROLLUP (a, b)
    UNION ALL
    SELECT 'cube', a, b, CAST(grouping(a) AS BIGINT), SUM(n) FROM finest GROUP BY CUBE (a, b)
    """,
    """
    SELECT 'sets' AS kind, l_returnflag AS a, l_linestatus AS b, grouping(l_returnflag) AS ga, COUNT(*) AS n
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())
    UNION ALL
    SELECT 'rollup', l_returnflag, l_linestatus, grouping(l_returnflag), COUNT(*)
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    UNION ALL
    SELECT 'cube', l_returnflag, l_linestatus, grouping(l_returnflag), COUNT(*)
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)

_AGG_HAVING = """
    SELECT o_custkey, COUNT(*) AS order_count,
           COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority = '1-URGENT')
                AS DOUBLE) AS urgent_total
    FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10
"""
sql_query("p_agg_having_filter", ["orders"], _AGG_HAVING, _AGG_HAVING)

# Estimates differ between engines, so this one has no checking SQL; the next one checks the error.
sql_query(
    "p_agg_approx",
    ["lineitem"],
    """
    SELECT l_returnflag, approx_count_distinct(l_orderkey) AS orders_estimate,
           percentile_approx(l_extendedprice, 0.5) AS median_estimate
    FROM lineitem GROUP BY l_returnflag
    """,
    None,
)

sql_query(
    "p_agg_approx_error",
    ["lineitem"],
    """
    WITH estimated AS (
        SELECT l_returnflag AS flag, approx_count_distinct(l_orderkey, 0.02) AS guess
        FROM lineitem GROUP BY l_returnflag
    ), exact AS (
        SELECT l_returnflag AS flag, COUNT(DISTINCT l_orderkey) AS order_count
        FROM lineitem GROUP BY l_returnflag
    )
    SELECT exact.flag, order_count, abs(guess - order_count) <= 0.1 * order_count AS within_bound
    FROM estimated JOIN exact ON estimated.flag = exact.flag
    """,
    """
    SELECT l_returnflag AS flag, COUNT(DISTINCT l_orderkey) AS order_count, true AS within_bound
    FROM lineitem GROUP BY l_returnflag
    """,
)

# Windows: at most one row per month and partition.
_MONTHLY = """
    WITH monthly AS (
        SELECT o_orderpriority AS priority, {month} AS month, COUNT(*) AS n,
               SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
        FROM orders GROUP BY o_orderpriority, {month}
    )
"""
_SPARK_MONTHLY = _MONTHLY.format(month="CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ)")
_DUCK_MONTHLY = _MONTHLY.format(month="CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)")

_WINDOW_RANK = """
    SELECT priority, month, n,
           CAST(row_number() OVER (PARTITION BY priority ORDER BY total DESC, month) AS BIGINT) AS row_no,
           CAST(rank() OVER (PARTITION BY priority ORDER BY n DESC) AS BIGINT) AS rank_no,
           CAST(dense_rank() OVER (PARTITION BY priority ORDER BY n DESC) AS BIGINT) AS dense_no,
           CAST(ntile(4) OVER (PARTITION BY priority ORDER BY total, month) AS BIGINT) AS quarter
    FROM monthly
"""
sql_query("p_window_rank", ["orders"], _SPARK_MONTHLY + _WINDOW_RANK, _DUCK_MONTHLY + _WINDOW_RANK)

_WINDOW_ANALYTIC = """
    SELECT priority, month, n, lag(n, 1) OVER w AS previous, lead(n, 2, -1) OVER w AS after_next,
           first_value(n) OVER w AS first_n,
           last_value(n) OVER (PARTITION BY priority ORDER BY month
               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_n
    FROM monthly WINDOW w AS (PARTITION BY priority ORDER BY month)
"""
sql_query(
    "p_window_analytic", ["orders"], _SPARK_MONTHLY + _WINDOW_ANALYTIC, _DUCK_MONTHLY + _WINDOW_ANALYTIC
)

_WINDOW_FRAME = """
    SELECT priority, month,
           CAST(SUM(n) OVER (PARTITION BY priority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
                AS BIGINT) AS three_rows,
           CAST(SUM(total) OVER (PARTITION BY priority ORDER BY month) AS DOUBLE) AS running_total,
           COUNT(*) OVER (PARTITION BY priority ORDER BY month
                RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS months_in_range
    FROM monthly
"""
sql_query("p_window_frame", ["orders"], _SPARK_MONTHLY + _WINDOW_FRAME, _DUCK_MONTHLY + _WINDOW_FRAME)

_SORT = """
    SELECT o_orderkey, o_custkey, o_totalprice, nullif(o_orderstatus, 'P') AS status FROM orders
    ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey
"""
sql_query("p_sort", ["orders"], _SORT, _SORT)

_TOPK = """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25
"""
sql_query("p_topk", ["orders"], _TOPK, _TOPK)

# Both sides are made distinct before INTERSECT and EXCEPT, which join on the whole row.
_SETOPS = """
    WITH buyers AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P'),
    rich AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000),
    nations AS (SELECT c_nationkey AS id, c_mktsegment AS s, COUNT(*) AS n FROM customer GROUP BY 1, 2)
    SELECT 'union' AS kind, id FROM (SELECT id FROM buyers UNION SELECT id FROM rich) u
    UNION ALL SELECT 'intersect', id FROM (SELECT id FROM buyers INTERSECT SELECT id FROM rich) i
    UNION ALL SELECT 'except', id FROM (SELECT id FROM rich EXCEPT SELECT id FROM buyers) e
    UNION ALL SELECT 'intersect all', id FROM (
        SELECT id FROM nations WHERE n > 1 INTERSECT ALL SELECT id FROM nations WHERE s <> 'BUILDING') ia
    UNION ALL SELECT 'except all', id FROM (
        SELECT id FROM nations EXCEPT ALL SELECT id FROM nations WHERE s = 'BUILDING') ea
"""
sql_query("p_setops", ["orders", "customer"], _SETOPS, _SETOPS)

sql_query(
    "p_subquery",
    ["orders", "customer", "nation"],
    """
    WITH spend AS (
        SELECT o_custkey, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
        FROM orders GROUP BY o_custkey
    )
    SELECT c_custkey, nation, n,
           CAST(total AS DOUBLE) AS total,
           total > (SELECT SUM(total) / COUNT(*) FROM spend) AS above_average,
           (SELECT MAX(n_regionkey) FROM nation WHERE n_nationkey = c_nationkey) AS region_key
    FROM customer JOIN spend ON c_custkey = o_custkey,
         LATERAL (SELECT MAX(n_name) AS nation FROM nation WHERE n_nationkey = c_nationkey)
    """,
    """
    WITH spend AS (
        SELECT o_custkey, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
        FROM orders GROUP BY o_custkey
    )
    SELECT c_custkey, nation, n,
           CAST(total AS DOUBLE) AS total,
           total > (SELECT SUM(total) / COUNT(*) FROM spend) AS above_average,
           (SELECT MAX(n_regionkey) FROM nation WHERE n_nationkey = c_nationkey) AS region_key
    FROM customer JOIN spend ON c_custkey = o_custkey,
         LATERAL (SELECT MAX(n_name) AS nation FROM nation WHERE n_nationkey = c_nationkey) l
    """,
)
