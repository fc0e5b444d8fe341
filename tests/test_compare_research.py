from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dataproof import compare_datasets, duplicate_rows, key_overlap, monthly_trend, research_dataset
from dataproof.operators.profile import column_statistics
from dataproof.operators.research import correlations, outliers


def test_compare(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, value bigint")
    right = spark.createDataFrame([(2, 25, "x"), (3, 30, "y")], "id bigint, value bigint, extra string")
    result = compare_datasets(left, right, ["id"])
    assert result.rows.first().asDict() == {"left_rows": 2, "right_rows": 2, "difference": 0, "percent_change": 0.0}
    only = [r["column"] for r in result.schema.where("side = 'right_only'").collect()]
    assert only == ["extra"]
    assert result.key_overlap.first().asDict() == {"keys": ["id"], "left_distinct": 2, "right_distinct": 2, "intersection": 1}
    assert [r["column"] for r in result.drift.collect()] == ["id", "value"]
    assert result.warnings == ()


def test_compare_empty_left(spark):
    left = spark.createDataFrame([], "id bigint")
    right = spark.createDataFrame([(1,)], "id bigint")
    result = compare_datasets(left, right, ["id"])
    assert result.rows.first()["percent_change"] is None
    assert result.key_overlap.first()["left_distinct"] == 0
    assert result.drift.first()["null_rate_delta"] == 0.0


def test_names_are_case_sensitive(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(1, "2")], "A int, b string")
    rows = [(r["column"], r["side"], r["type_changed"]) for r in compare_datasets(left, right).schema.collect()]
    assert rows == [("A", "right_only", False), ("a", "left_only", False), ("b", "shared", True)]


def test_warnings_name_their_side(spark):
    wide = spark.range(2).select(*[F.col("id").alias(f"c{i}") for i in range(103)])
    result = compare_datasets(wide, wide)
    assert not result.warnings
    assert all(r["null_rate_delta"] == 0 for r in result.drift.collect()) and result.drift.count() == 103
    limited = compare_datasets(wide, wide, max_columns=100)
    assert limited.warnings[0] == "left: profiled 100 of 103 columns, as asked."
    assert limited.drift.count() == 100


def test_unknown_keys(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="Only one side"):
        compare_datasets(df, df, ["b"])
    with pytest.raises(ValueError, match="1 to 8 keys"):
        key_overlap(df, df, [])


def test_key_overlap_with_nulls_and_hot_keys(spark):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 100).alias("k"), F.lit(1).alias("j"))
    right = spark.createDataFrame([(None, 1), (5, 1), (5, None)], "k bigint, j int")
    row = key_overlap(left, right, ["k", "j", "k"]).first()
    assert (row["left_distinct"], row["right_distinct"], row["intersection"]) == (101, 3, 2)


def test_key_overlap_shuffles_once(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    plan = key_overlap(df, df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None), (None, None), (None, None)], "a int, b int")
    assert duplicate_rows(df).first()[0] == duplicate_rows(df, exact=True).first()[0] == 3
    assert duplicate_rows(df.limit(0)).first()[0] == 0


def test_duplicates_of_nested_rows(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (array(1, NULL), map('a', 1, 'b', 2), named_struct('x', 1, 'y', CAST(NULL AS INT))),
        (array(1, NULL), map('b', 2, 'a', 1), named_struct('x', 1, 'y', CAST(NULL AS INT))),
        (array(NULL, 1), map('a', 1, 'b', 2), named_struct('x', CAST(NULL AS INT), 'y', 1)) AS t(a, m, s)"""
    )
    assert duplicate_rows(df).first()[0] == 1


def test_correlations(spark):
    rows = [(float(i), 2.0 * i + 1, 5.0, float((-1) ** i) if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, k double, n double")
    found = {(a, b): r for _, a, b, r in correlations(df, column_statistics(df, distinct=False, moments=False))}
    assert list(found) == [("a", "b"), ("a", "k"), ("a", "n"), ("b", "k"), ("b", "n"), ("k", "n")]
    assert found["a", "b"] == pytest.approx(1.0)
    assert found["a", "k"] is None and found["k", "n"] is None
    complete = df.where("n IS NOT NULL").toPandas()
    assert found["a", "n"] == pytest.approx(complete["a"].corr(complete["n"]))


def test_all_numeric_columns_are_correlated_and_fenced(spark):
    df = spark.range(30).select(*[(F.col("id") * F.col("id") % (i + 7)).alias(f"c{i}") for i in range(15)])
    statistics = column_statistics(df, distinct=False)
    assert len(correlations(df, statistics)) == 105 and len(outliers(df, statistics)) == 15
    assert len(correlations(df, statistics, 4)) == 6
    assert research_dataset(df, "x", max_columns=4).warnings[0] == "Looked at 4 of 15 numeric columns, as asked."


def test_outliers(spark):
    df = spark.createDataFrame([(float(v), None) for v in [1, 2, 3, 4, 5, 100]], "a double, e double")
    found = outliers(df, column_statistics(df, distinct=False))
    assert [(name, low, high, n) for _, name, low, high, n in found] == [("a", -1.5, 8.5, 1)]


def test_research(spark):
    rows = [(1, "APAC", 10, "2026-01-01"), (2, "EMEA", 20, "2026-02-01"), (3, "APAC", 30, "2026-03-01")]
    df = spark.createDataFrame(rows, "id bigint, region string, revenue bigint, date string")
    research = research_dataset(df, "Find quality and trends", date_column="date", metric_column="revenue")
    assert research.profile.summary.first()["row_count"] == 3
    assert [r["rows"] for r in research.trend.collect()] == [1, 1, 1]
    assert [str(r["total"]) for r in research.trend.collect()] == ["10", "20", "30"]
    assert [r["rule"] for r in research.findings.collect()] == ["strong_correlation"]
    assert research.duplicates.first()[0] == 0
    assert research.warnings[-1].startswith("The findings describe")


def test_findings_of_an_empty_dataset(spark):
    empty = spark.createDataFrame([], "a double")
    research = research_dataset(empty, "nothing")
    assert [r["rule"] for r in research.findings.collect()] == ["empty"]
    quiet = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    assert [r["rule"] for r in research_dataset(quiet, "q").findings.collect()] == ["none"]


def test_trend_arguments(spark):
    df = spark.createDataFrame([("2024-01-05", 7, "x")], "d string, n bigint, s string")
    with pytest.raises(ValueError, match="Unknown date column"):
        monthly_trend(df, "nope")
    with pytest.raises(ValueError, match="numeric column"):
        monthly_trend(df, "d", "s")
    assert monthly_trend(df, "n").count() == 0  # numbers are no dates


def test_trend_total_does_not_overflow(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("2024-01-05", big), ("2024-01-06", big)], "d string, n bigint")
    assert int(monthly_trend(df, "d", "n").first()["total"]) == 2 * big


def test_trend_has_all_periods(spark):
    df = spark.range(300).select(F.add_months(F.lit("2000-01-15").cast("date"), F.col("id").cast("int")).alias("d"))
    assert monthly_trend(df, "d").count() == 300
    rows = monthly_trend(df, "d", periods=240).collect()
    assert len(rows) == 240 and rows[0]["period"].year == 2000 and rows[-1]["period"].year == 2019


def test_key_overlap_of_large_integers_and_doubles(spark):
    left = spark.createDataFrame([(2**53,), (2**53 + 1,), (3,)], "k bigint")
    right = spark.createDataFrame([(float(2**53),), (3.0,), (3.5,), (-0.0,)], "k double")
    row = key_overlap(left, right, ["k"]).first()
    assert (row["left_distinct"], row["right_distinct"], row["intersection"]) == (3, 4, 2)
    exact = spark.sql("SELECT CAST('3.50' AS DECIMAL(10,2)) AS k UNION ALL SELECT 0")
    assert key_overlap(exact, right, ["k"]).first()["intersection"] == 2
