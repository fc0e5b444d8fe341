from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dataproof import chart_data
from dataproof.operators.charts import bins


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(1, "APAC", 10, "2026-01-01"), (2, "EMEA", 20, "2026-02-01"), (3, "APAC", 30, "2026-03-01")]
    df = spark.createDataFrame(rows, "id bigint, region string, revenue bigint, date string")
    return df.withColumn("date", F.col("date").cast("date"))


def test_bar(sales):
    chart = chart_data(sales, "region", "revenue", type="bar", aggregation="sum", limit=100)
    spec = chart.spec()
    assert spec["data"] == [{"type": "bar", "name": "dataset", "x": ["APAC", "EMEA"], "y": [40, 20]}]
    assert spec["layout"]["title"]["text"] == "Bar of region vs revenue"
    assert spec == chart_data(sales.repartition(3), "region", "revenue", type="bar", aggregation="sum", limit=100).spec()


@pytest.mark.parametrize("type,x,y", [("line", "date", "revenue"), ("scatter", "id", "revenue"), ("histogram", "revenue", None), ("box", "revenue", None)])
def test_limits(sales, type, x, y):
    chart = chart_data(sales, x, y, type=type, limit=2)
    assert chart.data.count() == 2
    assert chart.spec()["meta"]["rows"] == 2


def test_automatic_type(sales):
    assert chart_data(sales, "date", "revenue").chart_type == "line"
    assert chart_data(sales, "id", "revenue").chart_type == "scatter"
    assert chart_data(sales, "region", "revenue").chart_type == "bar"
    assert chart_data(sales, "date").chart_type == "bar"


def test_color_breaks_ties(spark):
    rows = [("A", "zeta", 10), ("A", None, 10), ("A", "beta", 10), ("A", "alpha", 10), ("B", "aaa", 10)]
    df = spark.createDataFrame(rows, "category string, series string, value bigint")
    for n in (1, 2, 5):
        chart = chart_data(df.repartition(n), "category", "value", "series", type="bar", aggregation="sum", limit=3)
        assert [trace["name"] for trace in chart.spec()["data"]] == ["alpha", "beta", "zeta"]
    names = [t["name"] for t in chart_data(df, "category", "value", "series", type="bar").spec()["data"]]
    assert names == ["alpha", "beta", "zeta", "(null)", "aaa"]


def test_errors(sales):
    with pytest.raises(ValueError, match="Unknown chart column"):
        chart_data(sales, "nope")
    with pytest.raises(ValueError, match="needs a y column"):
        chart_data(sales, "region", type="bar", aggregation="sum")
    with pytest.raises(ValueError, match="needs a y column"):
        chart_data(sales, "region", type="line")
    with pytest.raises(ValueError, match="limit"):
        chart_data(sales, "region", limit=5001)
    with pytest.raises(ValueError, match="Unknown chart type"):
        chart_data(sales, "region", type="pie")


def test_sampled_charts_ignore_input_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = chart_data(df, "l_extendedprice", color="l_returnflag", type="histogram", limit=50).spec()
    two = chart_data(df.orderBy("l_shipdate").repartition(5), "l_extendedprice", color="l_returnflag", type="histogram", limit=50).spec()
    assert one == two
    assert all(trace["nbinsx"] == bins(len(trace["x"])) for trace in one["data"])


def test_bins():
    assert [bins(n) for n in (0, 100, 400, 10_000, 90_000)] == [10, 10, 20, 100, 100]


def test_top_n_is_distributed(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = chart_data(df, "l_shipdate", "l_tax").data._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_hash_columns_keep_the_scan_narrow(spark, sf_dir):
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    chart = chart_data(lineitem, "l_quantity", "l_tax", type="scatter", hash_columns=["l_orderkey", "l_linenumber"])
    plan = chart.data._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_tax:double>" in plan
    assert chart.data.count() == 500
    again = chart_data(lineitem.repartition(7), "l_quantity", "l_tax", type="scatter", hash_columns=["l_orderkey", "l_linenumber"])
    assert again.data.collect() == chart.data.collect()
