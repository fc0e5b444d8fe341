"""Chart data of every chart type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.operators.charts import chart_data
from dataproof.queries.profile import _hash_sql
from dataproof.queries.registry import query, table


@query(
    """SELECT row_number() OVER (ORDER BY y DESC, x)::INTEGER AS ord, 'dataset' AS trace, x, y FROM (
       SELECT l_returnflag AS x, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1) ORDER BY ord LIMIT 500"""
)
def q_chart_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    chart = chart_data(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return chart.data.withColumn("y", F.round("y", 2))


@query(
    """SELECT row_number() OVER (ORDER BY y DESC, x, color NULLS LAST)::INTEGER AS ord,
              coalesce(color, '(null)') AS trace, x, y FROM (
       SELECT o_custkey % 100 AS x, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS color,
              count(*) AS y FROM orders GROUP BY 1, 2) ORDER BY ord LIMIT 150"""
)
def q_chart_bar_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with many ties: decided by x, then by color with NULL last."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey % 100 AS x", "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS color"
    )
    return chart_data(df, "x", color="color", limit=150).data


def _bar_sql(aggregate: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY y DESC, x, color NULLS LAST)::INTEGER AS ord, color AS trace, x, y FROM (
        SELECT l_returnflag AS x, l_linestatus AS color, {aggregate} AS y FROM (
            SELECT l_returnflag, l_linestatus, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price,
                   l_shipdate FROM lineitem)
        WHERE {'l_shipdate' if 'l_shipdate' in aggregate else 'price'} IS NOT NULL GROUP BY 1, 2) ORDER BY ord LIMIT 500"""


def _bar(spark: SparkSession, sf_dir: str, y: str, aggregation: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag",
        "l_linestatus",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price",
        "l_shipdate",
    )
    return chart_data(df, "l_returnflag", y, "l_linestatus", type="bar", aggregation=aggregation).data


@query(_bar_sql("round(avg(price), 4)"))
def q_chart_bar_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bar(spark, sf_dir, "price", "avg").withColumn("y", F.round("y", 4))


@query(_bar_sql("min(price)"))
def q_chart_bar_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bar(spark, sf_dir, "price", "min")


@query(_bar_sql("max(l_shipdate)"))
def q_chart_bar_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bar(spark, sf_dir, "l_shipdate", "max")


@query(
    """SELECT row_number() OVER (ORDER BY ts, event_id)::INTEGER AS ord, event_type AS trace, ts AS x, value AS y
       FROM events WHERE value IS NOT NULL QUALIFY ord <= 1000"""
)
def q_chart_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time against a number is a line by itself; event times are unique."""
    return chart_data(table(spark, sf_dir, "events"), "ts", "value", "event_type", limit=1000).data


@query(
    """SELECT row_number() OVER (ORDER BY o_orderkey)::INTEGER AS ord, 'dataset' AS trace, o_orderkey AS x,
              o_totalprice AS y FROM orders QUALIFY ord <= 500"""
)
def q_chart_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_data(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice").data


_CUSTOMER = _hash_sql("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(
    f"""SELECT row_number() OVER (ORDER BY c_nationkey, {_CUSTOMER})::INTEGER AS ord, 'dataset' AS trace,
        c_nationkey AS x, c_acctbal AS y FROM customer QUALIFY ord <= 300"""
)
def q_chart_scatter_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct x: the row hash decides which points are kept."""
    df = table(spark, sf_dir, "customer")
    return chart_data(df, "c_nationkey", "c_acctbal", type="scatter", limit=300, row_hash="portable").data


@query(
    f"""SELECT row_number() OVER (ORDER BY {_CUSTOMER})::INTEGER AS ord, c_mktsegment AS trace, c_acctbal AS x
        FROM customer QUALIFY ord <= 500"""
)
def q_chart_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return chart_data(df, "c_acctbal", color="c_mktsegment", type="histogram", row_hash="portable").data


@query(
    f"""SELECT c_mktsegment AS trace, count(*) AS points,
        greatest(10, least(100, floor(sqrt(count(*)) + 0.5)))::INTEGER AS bins FROM (
        SELECT c_mktsegment FROM customer ORDER BY {_CUSTOMER} LIMIT 5000) GROUP BY 1"""
)
def q_chart_histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    chart = chart_data(df, "c_acctbal", color="c_mktsegment", type="histogram", limit=5000, row_hash="portable")
    return chart.trace_sizes().drop("first")


@query(
    f"""SELECT row_number() OVER (ORDER BY {_CUSTOMER})::INTEGER AS ord, 'dataset' AS trace, c_acctbal AS y
        FROM customer QUALIFY ord <= 200"""
)
def q_chart_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without y, a box shows x."""
    return chart_data(table(spark, sf_dir, "customer"), "c_acctbal", type="box", limit=200, row_hash="portable").data
