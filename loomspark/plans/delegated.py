"""The delegated SQL surface (D1–D19): one read-only query per category, run through
``run_sql`` on the registered tables.  Each entry: (tables, Spark SQL, DuckDB SQL or None).

Money is summed as DECIMAL so both engines add exactly; every top-k has a unique
tie-break; dates are compared with DATE literals (the columns are TIMESTAMP_NTZ).
"""
from __future__ import annotations

DELEGATED: dict[str, tuple[tuple[str, ...], str, str | None]] = {}


def _add(name, tables, spark_sql, duck_sql="same"):
    DELEGATED[name] = (tuple(tables), spark_sql, spark_sql if duck_sql == "same" else duck_sql)


_add("sql_d1_scan_filter", ["lineitem"], """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag,
       CASE WHEN l_discount >= 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS discount_band
FROM lineitem
WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
  AND l_returnflag IN ('R', 'A') AND l_linestatus LIKE 'F%' AND l_quantity > 10
""")

_add("sql_d2_joins", ["nation", "customer", "orders"], """
SELECT n.n_name, count(o.o_orderkey) AS n_orders, count(DISTINCT c.c_custkey) AS n_customers,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM nation n
LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
GROUP BY n.n_name
""")

_add("sql_d2_full_outer", ["customer", "supplier", "nation"], """
WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey),
     s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey)
SELECT n.n_name, coalesce(c.customers, 0) AS customers, coalesce(s.suppliers, 0) AS suppliers
FROM c FULL OUTER JOIN s ON c.k = s.k
RIGHT JOIN nation n ON n.n_nationkey = coalesce(c.k, s.k)
""")

_add("sql_d3_semi_anti", ["orders", "lineitem"], """
SELECT o_orderstatus,
       count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS with_lines,
       count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS without_lines
FROM orders o GROUP BY o_orderstatus
""")

_add("sql_d3_anti_rows", ["orders", "lineitem"], """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
""")

_add("sql_d4_range_join", ["part"], """
WITH bands AS (SELECT * FROM VALUES (1, 900.0, 920.0), (2, 920.0, 950.0), (3, 950.0, 980.0), (4, 980.0, 1000.0)
               AS b(band, lo, hi))
SELECT b.band, count(*) AS parts, min(p.p_retailprice) AS min_price, max(p.p_retailprice) AS max_price
FROM part p JOIN bands b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi
GROUP BY b.band
""", """
WITH bands AS (SELECT * FROM (VALUES (1, 900.0, 920.0), (2, 920.0, 950.0), (3, 950.0, 980.0), (4, 980.0, 1000.0))
               AS b(band, lo, hi))
SELECT b.band, count(*) AS parts, min(p.p_retailprice) AS min_price, max(p.p_retailprice) AS max_price
FROM part p JOIN bands b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi
GROUP BY b.band
""")

# as-of: for each event (shifted 25 years back) the customer's latest order at or before it
_add("sql_d5_asof", ["events", "orders"], """
WITH e AS (SELECT event_id, user_id, ts - INTERVAL 25 YEARS AS ets FROM events),
u AS (
  SELECT user_id AS k, ets AS t, 1 AS kind, event_id, CAST(NULL AS BIGINT) AS o_orderkey FROM e
  UNION ALL
  SELECT o_custkey AS k, o_orderdate AS t, 0 AS kind, CAST(NULL AS BIGINT), o_orderkey FROM orders),
w AS (
  SELECT k, kind, event_id, t,
         last_value(o_orderkey, true) OVER (PARTITION BY k ORDER BY t, kind, o_orderkey
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_orderkey
  FROM u)
SELECT event_id, k AS user_id, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM w WHERE kind = 1
""", """
WITH e AS (SELECT event_id, user_id, ts - INTERVAL 25 YEAR AS ets FROM events),
best AS (
  SELECT e.event_id, e.user_id, max(o.o_orderdate) AS d
  FROM e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ets
  GROUP BY e.event_id, e.user_id)
SELECT b.event_id, b.user_id, CAST(max(o.o_orderkey) AS DOUBLE) AS o_orderkey
FROM best b LEFT JOIN orders o ON o.o_custkey = b.user_id AND o.o_orderdate = b.d
GROUP BY b.event_id, b.user_id
""")

_add("sql_d6_groupby", ["lineitem"], """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders,
       count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100
""")

_add("sql_d7_grouping_sets", ["orders"], """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(grouping(o_orderstatus) AS BIGINT) AS g_status, CAST(grouping(o_orderpriority) AS BIGINT) AS g_priority
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")

_add("sql_d7_rollup", ["orders"], """
SELECT CAST(year(o_orderdate) AS DOUBLE) AS y, o_orderstatus, count(*) AS n
FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)
""")

_add("sql_d8_windows", ["orders"], """
SELECT o_orderkey, o_custkey, o_orderdate,
       CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS price_rank,
       CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS prev_order,
       CAST(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS next_order,
       count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
FROM orders
""")

_add("sql_d9_topk", ["lineitem"], """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate
LIMIT 20 OFFSET 10
""")

_add("sql_d9_topk_per_group", ["lineitem"], """
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice, CAST(r AS BIGINT) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey
                               ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber, l_quantity, l_shipdate) AS r
  FROM lineitem) t
WHERE r <= 3
""")

_add("sql_d10_setops", ["customer", "supplier"], """
SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a
UNION ALL
SELECT 'union_all', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) b
UNION ALL
SELECT 'intersect', count(*) FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0
                                   INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) c
UNION ALL
SELECT 'except', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) d
UNION ALL
SELECT 'intersect_all', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) e
UNION ALL
SELECT 'except_all', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) f
""")

_add("sql_d11_subqueries", ["orders", "lineitem", "customer"], """
WITH big AS (SELECT o_custkey, o_totalprice, o_orderkey FROM orders
             WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
SELECT c.c_custkey, c.c_mktsegment,
       (SELECT count(*) FROM big b WHERE b.o_custkey = c.c_custkey) AS big_orders
FROM customer c
WHERE c.c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_mktsegment = c.c_mktsegment)
""")

_add("sql_d12_scalars", ["part", "orders"], """
SELECT p_partkey, upper(p_name) AS name_u, CAST(length(p_name) AS BIGINT) AS name_len,
       regexp_extract(p_brand, '([0-9]+)', 1) AS brand_no, substr(p_type, 1, 3) AS type3,
       concat(p_brand, '/', p_type) AS brand_type, abs(p_retailprice - 950) AS dist,
       CAST(floor(p_retailprice / 10) AS BIGINT) AS price_bucket, round(sqrt(p_retailprice), 4) AS price_sqrt,
       p_size % 7 AS size_mod, replace(p_name, ' ', '_') AS name_us
FROM part
""")

_add("sql_d12_dates", ["orders"], """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
       CAST(dayofmonth(o_orderdate) AS BIGINT) AS d,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_day,
       CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS due_day,
       CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age_days,
       CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS month_start
FROM orders
""", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m,
       CAST(day(o_orderdate) AS BIGINT) AS d,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_day,
       CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS due_day,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age_days,
       CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start
FROM orders
""")

_add("sql_d13_arrays", ["embeddings"], """
SELECT vec_id, label, CAST(size(embedding) AS BIGINT) AS dims,
       round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), CAST(0 AS DOUBLE),
                       (acc, x) -> acc + x), 6) AS sq_norm,
       CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positives,
       round(CAST(element_at(embedding, 1) AS DOUBLE), 6) AS first_dim,
       named_struct('id', vec_id, 'label', label).label AS label_again,
       map('label', label)['label'] AS label_from_map
FROM embeddings
""", """
SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dims,
       round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))),
                         lambda acc, x: acc + x), 6) AS sq_norm,
       CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positives,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first_dim,
       {'id': vec_id, 'label': label}.label AS label_again,
       map(['label'], [label])['label'] AS label_from_map
FROM embeddings
""")

_add("sql_d14_json", ["events"], """
SELECT event_type, count(*) AS n, CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS k_sum,
       max(CAST(get_json_object(props, '$.k') AS INT)) AS k_max
FROM events GROUP BY event_type
""", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum,
       max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS k_max
FROM events GROUP BY event_type
""")

_add("sql_d15_pivot", ["orders"], """
SELECT * FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus FROM orders)
PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))
""", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
FROM orders GROUP BY year(o_orderdate)
""")

_add("sql_d15_unpivot", ["customer"], """
SELECT c_custkey, metric, val FROM (
  SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance FROM customer)
UNPIVOT (val FOR metric IN (nation, balance))
""", """
SELECT c_custkey, 'nation' AS metric, CAST(c_nationkey AS DOUBLE) AS val FROM customer
UNION ALL SELECT c_custkey, 'balance', c_acctbal FROM customer
""")

_add("sql_d16_try_cast", ["customer"], """
WITH s AS (SELECT CAST(c_custkey AS STRING) AS id, CAST(c_acctbal AS STRING) AS bal, c_name FROM customer)
SELECT id, try_cast(id AS BIGINT) AS id_num, try_cast(bal AS DOUBLE) AS bal_num,
       try_cast(c_name AS DOUBLE) AS name_num
FROM s
""", """
WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal AS VARCHAR) AS bal, c_name FROM customer)
SELECT id, TRY_CAST(id AS BIGINT) AS id_num, TRY_CAST(bal AS DOUBLE) AS bal_num,
       TRY_CAST(c_name AS DOUBLE) AS name_num
FROM s
""")

_add("sql_d17_recursive", ["region", "nation", "supplier"], """
WITH RECURSIVE edges AS (
  SELECT concat('r', CAST(n_regionkey AS STRING)) AS parent, concat('n', CAST(n_nationkey AS STRING)) AS child FROM nation
  UNION ALL
  SELECT concat('n', CAST(s_nationkey AS STRING)), concat('s', CAST(s_suppkey AS STRING)) FROM supplier),
walk (node, root, depth) AS (
  SELECT concat('r', CAST(r_regionkey AS STRING)), r_name, 0 FROM region
  UNION ALL
  SELECT e.child, w.root, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT root, depth, count(*) AS nodes FROM walk GROUP BY root, depth
""", """
WITH RECURSIVE edges AS (
  SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS child FROM nation
  UNION ALL
  SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier),
walk (node, root, depth) AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name, 0 FROM region
  UNION ALL
  SELECT e.child, w.root, w.depth + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT root, depth, count(*) AS nodes FROM walk GROUP BY root, depth
""")

_add("sql_d18_approx", ["events"], """
SELECT event_type, approx_count_distinct(user_id) AS users_approx,
       percentile_approx(value, 0.5) AS median_value_approx
FROM events GROUP BY event_type
""", None)

_add("sql_d19_q1", ["lineitem"], """
SELECT l_returnflag, l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS sum_disc_price,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))
           * (1 + CAST(l_tax AS DECIMAL(18,2)))) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
""")

_add("sql_d19_q3", ["customer", "orders", "lineitem"], """
SELECT l.l_orderkey, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue,
       o.o_orderdate, o.o_orderpriority
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < DATE '1998-03-15' AND l.l_shipdate > DATE '1998-03-15'
GROUP BY l.l_orderkey, o.o_orderdate, o.o_orderpriority
ORDER BY revenue DESC, o.o_orderdate, l.l_orderkey LIMIT 10
""")

_add("sql_d19_q5", ["customer", "orders", "lineitem", "supplier", "nation", "region"], """
SELECT n.n_name, CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name = 'ASIA' AND o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01'
GROUP BY n.n_name
""")

_add("sql_d19_q6", ["lineitem"], """
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
