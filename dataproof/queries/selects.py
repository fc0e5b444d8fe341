"""User SQL through the read-only policy. The text is valid in both dialects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from dataproof.plans.select import safe_select
from dataproof.queries.registry import REGISTRY, Query, table


#: More rows than any of these queries gives at any scale: all of them group by columns of few values, or by bounded
#: numbers, or have a limit of their own.
ROWS = 10_000


def _register(name: str, tables: Sequence[str], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return safe_select(spark, {t: table(spark, sf_dir, t) for t in tables}, sql, ROWS).df

    run.__name__ = name
    REGISTRY[name] = Query(run, sql)


_register(
    "q_sql_join",
    ["customer", "orders", "lineitem"],
    """SELECT c_mktsegment, count(*) AS line_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       GROUP BY c_mktsegment ORDER BY c_mktsegment""",
)
_register(
    "q_sql_outer_joins",
    ["nation", "supplier"],
    """SELECT n_name, count(*) AS row_count, count(s_name) AS suppliers, min(s_name) AS first_name FROM (
       SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 9000
       UNION ALL
       SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_nationkey < 10) AS n
       FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 0) AS s ON n_nationkey = s_nationkey
       UNION ALL
       SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_nationkey > 20) AS n
       RIGHT JOIN supplier ON n_nationkey = s_nationkey) AS joined GROUP BY n_name""",
)
_register(
    "q_sql_semi_anti",
    ["customer", "orders"],
    """SELECT c_mktsegment, 'with' AS orders, count(*) AS customers FROM customer
       WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment
       UNION ALL SELECT c_mktsegment, 'without' AS orders, count(*) AS customers FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)
       GROUP BY c_mktsegment""",
)
_register(
    "q_sql_theta_cross",
    ["region", "nation"],
    """SELECT r.r_name, count(*) AS later_nations FROM region r JOIN nation n
       ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 2 * r.r_regionkey GROUP BY r.r_name""",
)
_register(
    "q_sql_cross",
    ["region", "orders"],
    """SELECT r_name, order_count, o_orderstatus FROM region
       CROSS JOIN (SELECT o_orderstatus, count(*) AS order_count FROM orders GROUP BY o_orderstatus) AS totals""",
)
_register(
    "q_sql_window",
    ["orders"],
    """SELECT least(n, 100) AS n, count(*) AS row_count, sum(priority_rank) AS ranks, sum(o_orderkey - previous) AS gaps,
              round(sum(running), 0) AS running_total FROM (
       SELECT o_custkey, o_orderkey, row_number() OVER w AS n,
              rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank,
              lag(o_orderkey) OVER w AS previous,
              sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS running
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) AS windowed GROUP BY least(n, 100)""",
)
_register(
    "q_sql_window_range",
    ["events"],
    """SELECT least(recent, 1000) AS recent, count(*) AS row_count, min(event_id) AS first_event, max(event_id) AS last_event FROM (
       SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
              RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS recent FROM events) AS windowed
       GROUP BY least(recent, 1000)""",
)
_register(
    "q_sql_cube",
    ["lineitem"],
    """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS all_flags, count(*) AS line_count,
              count(*) FILTER (WHERE l_discount > 0.05) AS discounted
       FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 1""",
)
_register(
    "q_sql_rollup",
    ["orders"],
    """SELECT o_orderstatus, o_orderpriority, count(*) AS order_count, round(avg(o_totalprice), 4) AS average
       FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
       UNION ALL SELECT o_orderstatus, NULL AS o_orderpriority, count(*) AS order_count, NULL AS average
       FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""",
)
_register(
    "q_sql_set_operations",
    ["orders", "customer"],
    """SELECT count(*) AS row_count, min(k) AS least, max(k) AS most, sum(k) AS total FROM (
       SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000
       INTERSECT SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0
       EXCEPT SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'
       UNION SELECT c_custkey AS k FROM customer WHERE c_acctbal < -990) AS combined""",
)
_register(
    "q_sql_cte",
    ["orders", "customer", "nation"],
    """WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey),
            ranked AS (SELECT n_name, c_custkey, total,
                              row_number() OVER (PARTITION BY n_name ORDER BY total DESC, c_custkey) AS n
                       FROM totals JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
       SELECT n_name, c_custkey, round(total, 2) AS total FROM ranked WHERE n <= 3 ORDER BY n_name, total DESC""",
)
_register(
    "q_sql_recursive",
    ["orders"],
    """WITH RECURSIVE months(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM months WHERE n < 11)
       SELECT n + 1 AS month_number, (SELECT count(*) FROM orders WHERE month(o_orderdate) = n + 1) AS order_count
       FROM months ORDER BY month_number""",
)
_register(
    "q_sql_pivot",
    ["lineitem"],
    """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
       PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS open_quantity, 'F' AS final_quantity))""",
)
_register(
    "q_sql_top",
    ["orders"],
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey
       LIMIT 100 OFFSET 20""",
)
_register(
    "q_sql_scalar",
    ["events"],
    """SELECT code, y, at_midnight, level, n, has_c, extreme_user, count(*) AS row_count, min(v) AS least, max(v) AS most FROM (
       SELECT upper(substr(event_type, 1, 3)) AS code, year(ts) AS y, date_trunc('day', ts) = ts AS at_midnight,
              coalesce(nullif(value, 0), -1) AS v, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level,
              TRY_CAST(event_type AS INTEGER) AS n, event_type LIKE '%c%' AS has_c,
              user_id IN (SELECT max(user_id) FROM events UNION SELECT min(user_id) FROM events)
                 OR value IS NOT DISTINCT FROM 0.0 AS extreme_user
       FROM events) AS spelled GROUP BY code, y, at_midnight, level, n, has_c, extreme_user""",
)
