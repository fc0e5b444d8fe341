from __future__ import annotations

import math
import random
import struct

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.hashing import portable_row_hash
from dataproof.functions.rendering import render
from dataproof.operators import quantiles
from dataproof.operators.frequencies import exact_distinct, top_values
from dataproof.operators.profile import _bracket_frame, column_statistics, profile_dataset, stable_sample


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(1, "APAC", 10, "2026-01-01"), (2, "EMEA", 20, "2026-02-01"), (3, "APAC", 30, "2026-03-01")]
    df = spark.createDataFrame(rows, "id bigint, region string, revenue bigint, date string")
    return df.withColumn("date", F.col("date").cast("date"))


def test_profile_of_sales(sales):
    profile = profile_dataset(sales)
    assert profile.summary.first().asDict() == {"row_count": 3, "column_count": 4}
    columns = {row["column"]: row for row in profile.columns.collect()}
    assert list(columns) == ["id", "region", "revenue", "date"]
    revenue = columns["revenue"]
    assert (revenue["minimum"], revenue["maximum"], revenue["mean"], revenue["median"]) == ("10", "30", 20.0, 20.0)
    assert revenue["standard_deviation"] == pytest.approx(math.sqrt(200 / 3))
    assert [tuple(v) for v in columns["region"]["top_values"]] == [("APAC", 2), ("EMEA", 1)]
    assert (columns["date"]["minimum"], columns["date"]["maximum"]) == ("2026-01-01", "2026-03-01")
    assert columns["region"]["mean"] is None and columns["region"]["minimum"] is None
    assert profile.sample.count() == 3 and profile.warnings == ()


def test_every_type(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        (1Y, 2S, 9223372036854775807L, 1.5F, 0.1D, 1.25BD, true, 'a', X'01', DATE '2024-01-31',
         TIMESTAMP '2024-01-31 01:02:03', TIMESTAMP_NTZ '2024-01-31 01:02:03.5', INTERVAL '1' DAY, INTERVAL '2' MONTH,
         array(1, NULL), map('k', 1), struct(1 AS a, NULL AS b), parse_json('{"a":1}')),
        (NULL, NULL, 9223372036854775806L, NULL, NULL, 1.50BD, false, NULL, X'02', DATE '2023-01-31',
         NULL, NULL, INTERVAL '3' DAY, NULL, array(NULL, 1), map('k', 2), NULL, parse_json('{"a":2}'))
        AS t(b, s, l, f, d, dec, bool, str, bin, day, ts, ntz, dt, ym, arr, m, st, v)"""
    )
    profile = profile_dataset(df)
    columns = {row["column"]: row for row in profile.columns.collect()}
    assert columns["l"]["maximum"] == "9223372036854775807" and columns["l"]["minimum"] == "9223372036854775806"
    assert columns["dec"]["maximum"] == "1.50" and columns["dec"]["mean"] == 1.375
    assert columns["ntz"]["minimum"] == "2024-01-31 01:02:03.5"
    assert columns["dt"]["minimum"] is not None and columns["ym"]["maximum"] is not None
    assert columns["arr"]["approximate_distinct"] == 2 and columns["m"]["approximate_distinct"] == 2
    assert columns["st"]["null_count"] == 1 and columns["st"]["null_rate"] == 0.5
    assert columns["bool"]["mean"] is None and columns["bool"]["top_values"] is not None
    for name in ("bin", "arr", "m", "st", "v"):
        assert columns[name]["top_values"] is None
    assert profile.sample.count() == 2


def test_void_column(spark):
    df = spark.sql("SELECT id, NULL AS v FROM range(2)")
    columns = {row["column"]: row for row in profile_dataset(df, distinct="exact").columns.collect()}
    assert columns["id"]["distinct_count"] == 2 and columns["v"]["null_count"] == 2
    assert columns["v"]["approximate_distinct"] == 0 and columns["v"]["distinct_count"] is None


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a double, b string")
    statistics = column_statistics(empty)
    assert statistics.row_count == 0
    assert [r["null_rate"] for r in statistics.records] == [0.0, 0.0]
    assert statistics.record("a")["median"] is None and statistics.record("b")["approximate_distinct"] == 0
    assert profile_dataset(empty).columns.count() == 2
    nulls = spark.createDataFrame([(None, None), (None, "x")], "a double, b string")
    record = column_statistics(nulls).record("a")
    assert record["null_count"] == 2 and record["mean"] is None and record["first_quartile"] is None


def test_non_finite_numbers(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,), (inf,), (None,)], "a double")
    record = column_statistics(df).record("a")
    # NaN sorts last: the ordered values are 1, 2, inf, nan.
    assert record["null_count"] == 1 and record["mean"] is None and record["max_number"] is None
    assert record["maximum"] == "nan" and record["min_number"] == 1.0
    assert record["first_quartile"] == 1.75 and record["median"] is None


def test_column_limit(spark):
    df = spark.range(5).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(104)])
    everything = profile_dataset(df)
    assert everything.columns.count() == 104 and everything.warnings == ()
    assert everything.statistics.record("c103")["median"] == 105.0
    limited = profile_dataset(df, max_columns=100)
    assert limited.columns.count() == 100 and limited.warnings == ("Profiled 100 of 104 columns, as asked.",)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "`a b` int, `c``d.e` double, `_salt` string")
    profile = profile_dataset(df)
    assert [row["column"] for row in profile.columns.collect()] == ["a b", "c`d.e", "_salt"]


def percentile(values, p):
    values = sorted(values)
    position = p * (len(values) - 1)
    low = math.floor(position)
    high = math.ceil(position)
    return values[low] + (values[high] - values[low]) * (position - low)


SHAPES = {
    "uniform": lambda r, i: r.random(),
    "hot_value": lambda r, i: 7.0 if i % 3 == 0 else r.gauss(0, 100),
    "hot_lowest": lambda r, i: -5.0 if i % 3 == 0 else float(i),
    "two_values": lambda r, i: float(i % 2),
    "constant": lambda r, i: 3.25,
    "heavy_tail": lambda r, i: 1e300 if i % 97 == 0 else math.exp(r.gauss(0, 20)),
    "sorted": lambda r, i: float(i),
    "tiny_steps": lambda r, i: 1.0 + i * 2.0**-52,
}


@pytest.mark.parametrize("limit", [2_000_000, 20, 0])
def test_quartiles_are_exact(spark, monkeypatch, limit):
    """Also with a limit so small that every bracket must be narrowed down to its end."""
    monkeypatch.setattr(quantiles, "LIST_LIMIT", limit)
    r = random.Random(5)
    rows = [tuple(shape(r, i) for shape in SHAPES.values()) for i in range(4001)]
    schema = T.StructType([T.StructField(name, T.DoubleType()) for name in SHAPES])
    statistics = column_statistics(spark.createDataFrame(rows, schema).repartition(7), distinct=False)
    for i, name in enumerate(SHAPES):
        values = [row[i] for row in rows]
        record = statistics.record(name)
        for p, key in ((0.25, "first_quartile"), (0.5, "median"), (0.75, "third_quartile")):
            assert record[key] == pytest.approx(percentile(values, p), rel=1e-12), (name, key)


def test_quartiles_survive_wrong_brackets(spark, monkeypatch):
    """The sketch only proposes: brackets that miss are found out by the counts."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"))
    wrong = [("a", 1000, 1000, [0.0, 999.0, 990.0, 995.0, 1.0, 2.0, 3.0, 3.0])]
    monkeypatch.setattr(quantiles, "RANK_MARGIN", 0.005)
    assert quantiles.exact_quantiles(df, wrong) == {"a": [249.75, 499.5, 749.25]}


@pytest.mark.parametrize("n", [1, 2, 3, 799, 800, 801])
def test_quartiles_of_few_rows(spark, n):
    values = [float((i * 7919) % 1009) for i in range(n)]
    record = column_statistics(spark.createDataFrame([(v,) for v in values], "a double")).record("a")
    assert record["first_quartile"] == percentile(values, 0.25)
    assert record["third_quartile"] == percentile(values, 0.75)


def test_approximate_quartiles(spark):
    df = spark.range(100_000).select(F.col("id").alias("a"))
    record = column_statistics(df, approx_quantiles=True).record("a")
    assert abs(record["median"] - 49_999.5) <= quantiles.RELATIVE_ERROR * 50_000


def plain_bucket(x):
    """By the parts of the number itself instead of a logarithm."""
    if x != x:
        return quantiles._BEYOND + 1
    if x == 0:
        return 0
    if math.isinf(x):
        return int(math.copysign(quantiles._BEYOND, x))
    mantissa, exponent = math.frexp(abs(x))
    place = (exponent - 1 + 1074) * 256 + math.floor((mantissa * 2 - 1) * 256) + 1
    return int(math.copysign(place, x))


def test_buckets_follow_the_parts_of_a_number(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    for e in range(-1074, 1024, 3):
        values += [math.ldexp(1.0, e), math.nextafter(math.ldexp(1.0, e), 0), math.nextafter(math.ldexp(1.0, e), math.inf)]
    values += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    found = [b for (b,) in df.select(quantiles.number_bucket(F.col("x"))).collect()]
    assert found == [plain_bucket(x) for x in values]
    for x, bucket in zip(values, found):
        if math.isfinite(x) and abs(x) > 1e-300:
            assert abs(quantiles.bucket_middle(bucket) - x) <= quantiles.RELATIVE_ERROR * abs(x)


def test_buckets_are_generated_code(spark):
    values = [None, -2.5, 0.0, 0.75, 1e300, math.inf, math.nan]
    df = spark.createDataFrame([(x,) for x in values], "x double").coalesce(1)
    found = df.select(quantiles.number_bucket(F.col("x")).alias("bucket"))
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
    assert [b for (b,) in found.collect()] == [None if x is None else plain_bucket(x) for x in values]


def test_approximate_quantiles_of_odd_columns(spark):
    rng = random.Random(3)
    wild = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(999)]
    rows = [(x, None if i % 2 else float(i), None, math.nan if i > 300 else 1.0, 7) for i, x in enumerate(wild)]
    df = spark.createDataFrame(rows, "wild double, `half.full` double, empty double, nan double, seven int")
    names = df.columns
    found = quantiles.approximate_quantiles(df, names)
    for parts in (1, 5, 64):
        assert quantiles.approximate_quantiles(df.repartition(parts), names) == found
    assert set(found) == {"wild", "half.full", "nan", "seven"}
    for value, p in zip(found["wild"], (0.25, 0.5, 0.75)):
        exact = percentile(wild, p)
        assert abs(value - exact) <= quantiles.RELATIVE_ERROR * abs(exact) * 1.01
    assert found["nan"] == [quantiles.bucket_middle(plain_bucket(1.0)), None, None]
    assert quantiles.approximate_quantiles(df.where("false"), names) == {}
    record = column_statistics(df, approx_quantiles=True).record("wild")
    assert [record["first_quartile"], record["median"], record["third_quartile"]] == found["wild"]


def test_quantile_plan_has_no_unbounded_aggregate(spark, sf_dir):
    """Neither exact percentiles nor collected columns: a sketch, and for values a ranking of their counts."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sketched = _bracket_frame(lineitem, lineitem.schema.fields)._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in sketched and "collect_list" not in sketched
    top = top_values(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema.fields)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("partial_count") >= 1


def test_skewed_values_are_counted_in_full(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    rows = top_values(df, df.schema.fields, 2).collect()
    assert [(r["value"], r["count"]) for r in rows] == [("-1", 10_000), ("1", 1)]
    assert exact_distinct(df, df.schema.fields).first()["distinct_count"] == 20_001


def test_null_is_a_frequent_value(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), (None,), ("b",)], "v string")
    rows = top_values(df, df.schema.fields).collect()
    assert sorted((r["rank"], r["value"], r["count"]) for r in rows) == [(1, "b", 2), (2, None, 2), (3, "a", 1)]


@pytest.mark.parametrize("kind", ["fast", "portable"])
def test_sample_does_not_depend_on_partitioning(spark, sf_dir, kind):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    expected = stable_sample(df, 20, kind).collect()
    for other in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("o_totalprice"))):
        assert stable_sample(other, 20, kind).collect() == expected


def test_statistics_do_not_depend_on_partitioning(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = column_statistics(df.repartition(1))
    other = column_statistics(df.repartition(13))
    for a, b in zip(base.records, other.records):
        for key, value in a.items():
            assert b[key] == (pytest.approx(value, rel=1e-9) if isinstance(value, float) else value), (a["column"], key)


def test_rendering_matches_the_oracle_engine(spark):
    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e7, 12345678.9, 1e15, 9999999999999998.0, 1e16, 1.5e16, 1e22, 1e100, -2.5e-10]
    numbers += [0.001, 0.0001, 0.00012345, 0.00001, 1.7976931348623157e308, 123456789012345.67, 2.5e-5, float("inf")]
    numbers += [-float("inf"), float("nan"), 0.30000000000000004, 1 / 3, 2 / 3 * 1e-4]
    r = random.Random(3)
    numbers += [r.uniform(-1, 1) * 10 ** r.randint(-20, 25) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], "i int, v double")
    found = {row["i"]: row["t"] for row in df.select("i", render(F.col("v"), T.DoubleType()).alias("t")).collect()}
    connection = duckdb.connect()
    wrong = []
    for i, v in enumerate(numbers):
        expected = connection.execute("SELECT CAST(?::DOUBLE AS VARCHAR)", [v]).fetchone()[0]
        if found[i] != expected:
            wrong.append((v, found[i], expected))
    assert wrong == []


def test_row_hash_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (11, None), (1, 1)], "a int, b int")
    hashed = df.select(portable_row_hash(df.schema.fields).alias("h"))
    assert hashed.distinct().count() == 5


def test_nearly_unique_columns_can_be_left_out(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    profile = profile_dataset(df, max_distinct_rate=0.5)
    assert {r["column"] for r in profile.top_values.collect()} == {"k"}
    assert profile.warnings == ("No frequent values of nearly unique columns, as asked: id.",)
