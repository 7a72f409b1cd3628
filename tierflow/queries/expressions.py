"""Function families, pivot, SQL functions, generators and time windows, each as one SQL text."""

from __future__ import annotations

from tierflow.queries.registry import sql_query

sql_query(
    "p_fn_string",
    ["part", "pages"],
    """
    SELECT p_partkey AS id, upper(p_name) AS up, trim(concat('  ', p_brand, ' ')) AS trimmed,
           substr(p_type, 2, 3) AS part, concat_ws('|', p_brand, p_type) AS joined,
           lpad(CAST(p_size AS STRING), 5, '0') AS padded,
           regexp_replace(p_name, '[aeiou]', '') AS no_vowels,
           regexp_extract(p_brand, '([0-9]+)', 1) AS digits, CAST(length(p_name) AS BIGINT) AS len
    FROM part
    UNION ALL
    SELECT page_id, lower(url), reverse(url), left(url, 7), replace(url, 'http', 'HTTP'),
           rpad(substr(url, 1, 3), 5, '*'), element_at(split(url, '/'), -1),
           CAST(instr(url, '.com') AS STRING), CAST(size(split(url, '/')) AS BIGINT)
    FROM pages
    """,
    """
    SELECT p_partkey AS id, upper(p_name) AS up, trim('  ' || p_brand || ' ') AS trimmed,
           substr(p_type, 2, 3) AS part, concat_ws('|', p_brand, p_type) AS joined,
           lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded,
           regexp_replace(p_name, '[aeiou]', '', 'g') AS no_vowels,
           regexp_extract(p_brand, '([0-9]+)', 1) AS digits, CAST(length(p_name) AS BIGINT) AS len
    FROM part
    UNION ALL
    SELECT page_id, lower(url), reverse(url), left(url, 7), replace(url, 'http', 'HTTP'),
           rpad(substr(url, 1, 3), 5, '*'), string_split(url, '/')[-1],
           CAST(instr(url, '.com') AS VARCHAR), CAST(len(string_split(url, '/')) AS BIGINT)
    FROM pages
    """,
)

sql_query(
    "p_fn_date",
    ["orders", "events"],
    """
    SELECT o_orderkey AS id, CAST(date_trunc('MONTH', o_orderdate) AS TIMESTAMP_NTZ) AS truncated,
           CAST(date_add(CAST(o_orderdate AS DATE), 30) AS TIMESTAMP_NTZ) AS later,
           CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days_left,
           CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS quarter,
           CAST(year(o_orderdate) AS BIGINT) AS year_no,
           date_format(o_orderdate, 'yyyy-MM-dd') AS text
    FROM orders
    UNION ALL
    SELECT event_id, CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ), timestampadd(MINUTE, 90, ts),
           CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS BIGINT),
           CAST(hour(ts) AS BIGINT), CAST(dayofyear(ts) AS BIGINT), date_format(ts, 'HH:mm:ss')
    FROM events
    """,
    """
    SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS truncated,
           CAST(CAST(o_orderdate AS DATE) + 30 AS TIMESTAMP) AS later,
           date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days_left,
           extract(quarter FROM o_orderdate) AS quarter, year(o_orderdate) AS year_no,
           strftime(o_orderdate, '%Y-%m-%d') AS text
    FROM orders
    UNION ALL
    SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP), ts + INTERVAL 90 MINUTE,
           CAST(floor(epoch(ts - TIMESTAMP '2024-01-01')) AS BIGINT),
           hour(ts), dayofyear(ts), strftime(ts, '%H:%M:%S')
    FROM events
    """,
)

sql_query(
    "p_fn_math",
    ["lineitem"],
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 1) AS DOUBLE) AS r,
           CAST(floor(CAST(l_tax AS DECIMAL(4,2)) * 100) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c,
           abs(l_quantity - 25) AS a, power(l_linenumber, 2) AS p, pmod(l_linenumber - 4, 3) AS m,
           greatest(l_quantity, 10.0D) AS g, least(l_partkey, l_suppkey) AS l, sign(l_quantity - 25) AS s
    FROM lineitem
    """,
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)), 1) AS DOUBLE) AS r,
           CAST(floor(CAST(l_tax AS DECIMAL(4,2)) * 100) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c,
           abs(l_quantity - 25) AS a, power(l_linenumber, 2) AS p,
           CAST(((l_linenumber - 4) % 3 + 3) % 3 AS INTEGER) AS m,
           greatest(l_quantity, 10.0) AS g, least(l_partkey, l_suppkey) AS l,
           CAST(sign(l_quantity - 25) AS DOUBLE) AS s
    FROM lineitem
    """,
)

# Per document, and over all words by language; words are counted before the shuffle.
sql_query(
    "p_fn_array",
    ["documents"],
    """
    WITH split_words AS (SELECT doc_id, lang, split(text, ' ') AS words FROM documents)
    SELECT CAST(doc_id AS STRING) AS name, CAST(size(words) AS BIGINT) AS word_count,
           CAST(size(array_distinct(words)) AS BIGINT) AS distinct_words,
           CAST(size(filter(words, w -> length(w) > 5)) AS BIGINT) AS long_words,
           array_max(words) AS last_word, array_contains(words, 'the') AS has_the,
           array_join(slice(words, 1, 3), ' ') AS beginning
    FROM split_words
    UNION ALL
    SELECT concat(lang, length(word)), COUNT(*), NULL, COUNT_IF(length(word) > 5), NULL, NULL, NULL
    FROM split_words LATERAL VIEW explode(words) w AS word GROUP BY lang, length(word)
    """,
    """
    WITH split_words AS (SELECT doc_id, lang, string_split(text, ' ') AS words FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS name, len(words) AS word_count,
           CAST(len(list_distinct(words)) AS BIGINT) AS distinct_words,
           len(list_filter(words, lambda w: length(w) > 5)) AS long_words,
           list_max(words) AS last_word, list_contains(words, 'the') AS has_the,
           array_to_string(words[1:3], ' ') AS beginning
    FROM split_words
    UNION ALL
    SELECT lang || length(word), COUNT(*), NULL, COUNT(*) FILTER (WHERE length(word) > 5), NULL, NULL, NULL
    FROM (SELECT lang, unnest(words) AS word FROM split_words) GROUP BY lang, length(word)
    """,
)

sql_query(
    "p_fn_map_struct",
    ["events"],
    """
    WITH shaped AS (
        SELECT event_id, map_from_arrays(array('type', 'user'), array(event_type, CAST(user_id AS STRING))) AS m,
               named_struct('kind', event_type, 'amount', value) AS s
        FROM events
    )
    SELECT event_id, array_join(array_sort(map_keys(m)), ',') AS keys, element_at(m, 'type') AS type_value,
           m['user'] AS user_value, s.kind AS kind, s.amount AS amount,
           CAST(cardinality(map_concat(m, map('extra', '1'))) AS BIGINT) AS entries,
           map_contains_key(m, 'nope') AS has_nope
    FROM shaped
    """,
    """
    SELECT event_id, 'type,user' AS keys, event_type AS type_value, CAST(user_id AS VARCHAR) AS user_value,
           event_type AS kind, value AS amount, CAST(3 AS BIGINT) AS entries, false AS has_nope
    FROM events
    """,
)

sql_query(
    "p_fn_json",
    ["events"],
    """
    SELECT event_id, get_json_object(props, '$.k') AS k_text, from_json(props, 'k BIGINT').k AS k_number,
           to_json(named_struct('id', event_id, 'kind', event_type)) AS rebuilt,
           CAST(json_array_length(concat('[', props, ',', props, ']')) AS BIGINT) AS copies,
           get_json_object(props, '$.missing') AS nothing
    FROM events
    """,
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k_text,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number,
           '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS rebuilt,
           CAST(2 AS BIGINT) AS copies, json_extract_string(props, '$.missing') AS nothing
    FROM events
    """,
)

sql_query(
    "p_fn_null",
    ["orders"],
    """
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
           nvl(nullif(o_orderpriority, '5-LOW'), 'low') AS priority,
           if(o_totalprice > 200000, 'big', 'small') AS kind,
           try_cast(substr(o_orderpriority, 1, 1) AS INT) AS digit,
           try_cast(o_orderpriority AS INT) AS no_number,
           try_divide(o_totalprice, o_custkey % 10) AS ratio,
           nvl2(nullif(o_orderstatus, 'F'), 1, 0) AS open_flag, isnull(nullif(o_orderstatus, 'O')) AS is_o
    FROM orders
    """,
    """
    SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
           coalesce(nullif(o_orderpriority, '5-LOW'), 'low') AS priority,
           CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS kind,
           TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS digit,
           TRY_CAST(o_orderpriority AS INTEGER) AS no_number,
           o_totalprice / nullif(o_custkey % 10, 0) AS ratio,
           CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN 1 ELSE 0 END AS open_flag,
           nullif(o_orderstatus, 'O') IS NULL AS is_o
    FROM orders
    """,
)

sql_query(
    "p_pivot",
    ["orders"],
    """
    SELECT * FROM (
        SELECT o_orderpriority AS priority, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS total
        FROM orders
    ) PIVOT (COUNT(*) AS n, CAST(SUM(total) AS DOUBLE) AS total
             FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))
    """,
    """
    SELECT o_orderpriority AS priority,
           COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f_n,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS f_total,
           COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o_n,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS o_total,
           COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p_n,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS p_total
    FROM orders GROUP BY o_orderpriority
    """,
)

sql_query(
    "p_sql_udf",
    ["lineitem"],
    """
    CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DECIMAL(18,2), discount DECIMAL(4,2))
        RETURNS DECIMAL(24,4) RETURN price * (1 - discount);
    SELECT l_suppkey,
           CAST(SUM(net_price(CAST(l_extendedprice AS DECIMAL(18,2)), CAST(l_discount AS DECIMAL(4,2))))
                AS DOUBLE) AS net
    FROM lineitem GROUP BY l_suppkey
    """,
    """
    SELECT l_suppkey,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
                AS DOUBLE) AS net
    FROM lineitem GROUP BY l_suppkey
    """,
)

sql_query(
    "p_udtf_builtin",
    ["conversations", "part"],
    """
    SELECT word, COUNT(*) AS uses, CAST(MIN(pos) AS BIGINT) AS first_pos
    FROM conversations, LATERAL posexplode(split(text, ' ')) AS w(pos, word) GROUP BY word
    UNION ALL
    SELECT concat('size ', CAST(step AS STRING)), COUNT(*), CAST(MIN(p_size) AS BIGINT)
    FROM part, LATERAL explode(sequence(1, p_size)) AS s(step) GROUP BY step
    """,
    """
    SELECT word, COUNT(*) AS uses, MIN(pos) - 1 AS first_pos
    FROM (SELECT unnest(string_split(text, ' ')) AS word,
                 unnest(range(1, CAST(len(string_split(text, ' ')) AS BIGINT) + 1)) AS pos FROM conversations)
    GROUP BY word
    UNION ALL
    SELECT 'size ' || step, COUNT(*), MIN(p_size)
    FROM (SELECT unnest(range(1, CAST(p_size AS BIGINT) + 1)) AS step, p_size FROM part) GROUP BY step
    """,
)

# Sessions are built from one row per user and minute, so a busy user costs minutes, not events. A row
# stands for its events from the first to the last: the gap begins at the last.
sql_query(
    "p_time_window",
    ["events"],
    """
    WITH per_minute AS (
        SELECT user_id, MIN(ts) AS first, MAX(ts) AS last, COUNT(*) AS n
        FROM events GROUP BY user_id, date_trunc('MINUTE', ts)
    ), spans AS (
        SELECT user_id, first, n, make_interval(0, 0, 0, 0, 6, 0,
            CAST(unix_micros(CAST(last AS TIMESTAMP)) - unix_micros(CAST(first AS TIMESTAMP)) AS DECIMAL(18,0)) / 1000000
        ) AS gap
        FROM per_minute
    )
    SELECT 'tumbling' AS kind, window(ts, '15 minutes').start AS opened, COUNT(*) AS n, CAST(NULL AS BIGINT) AS user_id
    FROM events GROUP BY window(ts, '15 minutes')
    UNION ALL
    SELECT 'sliding', window(ts, '1 hour', '30 minutes').start, COUNT(*), NULL
    FROM events GROUP BY window(ts, '1 hour', '30 minutes')
    UNION ALL
    SELECT 'session', session_window(first, gap).start, SUM(n), user_id
    FROM spans GROUP BY user_id, session_window(first, gap)
    """,
    """
    WITH gaps AS (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR
                       THEN 0 ELSE 1 END AS is_new FROM events
    ), numbered AS (
        SELECT *, SUM(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM gaps
    ), slides AS (
        SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * unnest([0, 1])) AS opened FROM events
    )
    SELECT 'tumbling' AS kind, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS TIMESTAMP) AS opened, COUNT(*) AS n,
           CAST(NULL AS BIGINT) AS user_id
    FROM events GROUP BY 2
    UNION ALL SELECT 'sliding', CAST(opened AS TIMESTAMP), COUNT(*), NULL FROM slides GROUP BY opened
    UNION ALL SELECT 'session', MIN(ts), COUNT(*), user_id
    FROM numbered GROUP BY user_id, session_no
    """,
)
