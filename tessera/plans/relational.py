"""SQL on a pinned set of tables: the relational statements that users of the versioned store run.

A snapshot's tables are registered as views and the statement goes to Spark SQL as it is, so
parsing, planning and execution are Spark's own.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def open_snapshot(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> None:
    """Registers the snapshot's tables as views of the session. Views read nothing until they are asked."""
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    named = tuple(t for t in TABLES if re.search(rf"\b{t}\b", sql))  # opening a table reads its footer

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        open_snapshot(spark, sf_dir, named)
        return spark.sql(sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


_MONEY = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)".format

statement("sql_point_filter", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 77")
statement("sql_scan_aggregate", "SELECT count(*) AS n, coalesce(sum(length(text)), 0) AS total FROM documents", "SELECT count(*) AS n, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total FROM documents")
statement("sql_projection", "SELECT p_partkey, p_name, p_size * 2 AS double_size, p_brand || '/' || p_type AS label FROM part WHERE p_size > 25")
statement("sql_order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
statement("sql_pricing_summary", f"""SELECT l_returnflag, l_linestatus, {_MONEY('l_quantity')} AS sum_qty, {_MONEY('l_extendedprice')} AS sum_price,
  count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
statement("sql_join_inner", f"""SELECT n_name, {_MONEY('o_totalprice')} AS revenue, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
statement("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
statement("sql_join_full", """SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) a
  FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) b ON a.k = b.k""")
statement("sql_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
statement("sql_anti_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 90000)")
statement("sql_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
statement("sql_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
statement("sql_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
statement("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
statement("sql_cube", "SELECT c_mktsegment, c_nationkey % 5 AS zone, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 5)")
statement("sql_grouping_sets", "SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
statement("sql_window_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
statement("sql_window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events")
statement("sql_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
statement("sql_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
statement("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
statement("sql_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m")
statement("sql_recursive", "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 40) SELECT n, total FROM steps")
statement("sql_scalar_subquery", "SELECT p_partkey, p_retailprice FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand)")
statement("sql_case_null", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'even' END AS kind, nullif(c_nationkey, 3) AS other, coalesce(nullif(c_mktsegment, 'FURNITURE'), 'none') AS segment FROM customer")
statement("sql_strings", "SELECT doc_id, upper(source) AS head, substring(text, 1, 12) AS start, length(trim(source)) AS n, replace(source, 'src', '#') AS s, lpad(CAST(doc_id AS STRING), 6, '0') AS k, reverse(source) AS back FROM documents",
          "SELECT doc_id, upper(source) AS head, substring(text, 1, 12) AS start, CAST(length(trim(source)) AS INTEGER) AS n, replace(source, 'src', '#') AS s, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS k, reverse(source) AS back FROM documents")
statement("sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS first_day, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders",
          "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS age FROM orders")
statement("sql_math", "SELECT l_orderkey, l_linenumber, abs(CAST(l_quantity AS INT) - 25) AS d, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k, l_partkey % 7 AS r, greatest(l_suppkey, l_linenumber) AS g FROM lineitem",
          "SELECT l_orderkey, l_linenumber, abs(CAST(l_quantity AS INT) - 25) AS d, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS k, l_partkey % 7 AS r, greatest(l_suppkey, l_linenumber) AS g FROM lineitem")
statement("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
statement("sql_range_join", """SELECT p_partkey, b.lo FROM part JOIN (SELECT DISTINCT p_size AS lo FROM part WHERE p_size % 10 = 0) b ON p_size - p_size % 10 = b.lo - b.lo % 10 AND p_size >= b.lo AND p_size < b.lo + 10""")
statement("sql_asof_join", """SELECT event_id, latest AS o_orderkey FROM (
  SELECT event_id, last_value(o_orderkey) IGNORE NULLS OVER (PARTITION BY u ORDER BY t, kind, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest FROM (
    SELECT o_custkey AS u, CAST(o_orderdate AS TIMESTAMP_NTZ) AS t, 0 AS kind, o_orderkey AS k, o_orderkey, CAST(NULL AS BIGINT) AS event_id FROM orders
    UNION ALL SELECT user_id, CAST(ts AS TIMESTAMP_NTZ) - INTERVAL '9000' DAY, 1, event_id, NULL, event_id FROM events) x) y WHERE event_id IS NOT NULL""",
          """SELECT event_id, arg_max(o_orderkey, ROW(o_orderdate, o_orderkey)) AS o_orderkey FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts - INTERVAL '9000' DAY GROUP BY event_id""")  # fmt: skip
statement("sql_tumbling_window", "SELECT w.start AS start, event_type, n FROM (SELECT window(ts, '1 day') AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 day'), event_type)",
          "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
statement("sql_sliding_window", "SELECT w.start AS start, event_type, n FROM (SELECT window(ts, '2 days', '1 day') AS w, event_type, count(*) AS n FROM events GROUP BY window(ts, '2 days', '1 day'), event_type)",
          "SELECT start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start, event_type FROM events) x GROUP BY 1, 2")
statement("sql_session_window", "SELECT user_id, w.start AS start, n FROM (SELECT session_window(ts, '2 hours') AS w, user_id, count(*) AS n FROM events GROUP BY session_window(ts, '2 hours'), user_id)",
          """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events) x) y GROUP BY user_id, s""")  # fmt: skip
statement("sql_interval_join", """SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL '1' HOUR""",
          """SELECT a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 HOUR""")  # fmt: skip
statement("sql_merge_version", """SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN c.c_acctbal ELSE n.balance END AS c_acctbal FROM customer c
  FULL JOIN (SELECT o_custkey + CASE WHEN o_custkey % 50 = 0 THEN 100000000 ELSE 0 END AS k, count(*) * 1.0D AS balance, bool_or(o_orderstatus = 'P') AS gone FROM orders GROUP BY 1) n ON n.k = c.c_custkey WHERE NOT coalesce(n.gone, false)""",
          """SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NULL THEN c.c_acctbal ELSE n.balance END AS c_acctbal FROM customer c
  FULL JOIN (SELECT o_custkey + CASE WHEN o_custkey % 50 = 0 THEN 100000000 ELSE 0 END AS k, CAST(count(*) AS DOUBLE) AS balance, bool_or(o_orderstatus = 'P') AS gone FROM orders GROUP BY 1) n ON n.k = c.c_custkey WHERE NOT coalesce(n.gone, false)""")  # fmt: skip
statement("sql_pivot", "SELECT * FROM (SELECT event_type, user_id % 4 AS part FROM events) PIVOT (count(*) FOR part IN (0 AS p0, 1 AS p1, 2 AS p2, 3 AS p3))",
          "SELECT event_type, count(*) FILTER (user_id % 4 = 0) AS p0, count(*) FILTER (user_id % 4 = 1) AS p1, count(*) FILTER (user_id % 4 = 2) AS p2, count(*) FILTER (user_id % 4 = 3) AS p3 FROM events GROUP BY event_type")
statement("sql_arrays", "SELECT doc_id, size(split(source, 'c')) AS parts, array_contains(array(1, 2, 3), CAST(doc_id % 5 AS INT)) AS has, array_join(sort_array(array(source, 'a', 'z')), ',') AS joined FROM documents",
          "SELECT doc_id, CAST(len(string_split(source, 'c')) AS INTEGER) AS parts, list_contains([1, 2, 3], CAST(doc_id % 5 AS INT)) AS has, array_to_string(list_sort([source, 'a', 'z']), ',') AS joined FROM documents")
