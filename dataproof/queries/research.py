"""Duplicates, correlations, outliers, trends, findings and comparisons."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.operators.compare import compare_datasets, key_overlap, schema_drift
from dataproof.operators.frequencies import exact_distinct
from dataproof.operators.profile import DISTINCT_ERROR, column_statistics
from dataproof.operators.research import correlations, duplicate_rows, monthly_trend, outliers, research_dataset
from dataproof.queries.registry import query, table

_COPIES = ("o_custkey", "o_orderstatus", "o_orderpriority")
_NULL_KEY = "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END"


@query("SELECT count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)) AS duplicate_rows FROM orders")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "orders").select(*_COPIES))


@query(
    f"""SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_NULL_KEY} AS k, o_orderstatus FROM orders))
        AS duplicate_rows FROM orders"""
)
def q_duplicates_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "orders").selectExpr(f"{_NULL_KEY} AS k", "o_orderstatus"))


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents")
def q_duplicates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"), exact=True)


_PART = {
    "p_partkey": "p_partkey",
    "p_size": "p_size",
    "p_retailprice": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END",
    "twice": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2 * p_size + 1 END",
    "k": "CAST(1 AS DOUBLE)",
}
_PART_SELECT = [f"{expression} AS {name}" for name, expression in _PART.items()]


def _pairs_sql(source: str, names: list[str]) -> str:
    parts = [
        f"""SELECT '{a}' AS left_column, '{b}' AS right_column,
            CASE WHEN isfinite(corr({a}, {b})) THEN round(corr({a}, {b}), 6) END AS correlation FROM d"""
        for a, b in combinations(names, 2)
    ]
    return f"WITH d AS ({source}) " + " UNION ALL ".join(parts)


def _correlations(df: DataFrame) -> DataFrame:
    statistics = column_statistics(df, distinct=False, moments=False)
    rows = [(a, b, r) for _, a, b, r in correlations(df, statistics)]
    frame = df.sparkSession.createDataFrame(rows, "left_column string, right_column string, correlation double")
    return frame.withColumn("correlation", F.round("correlation", 6))


@query(_pairs_sql(f"SELECT {', '.join(_PART_SELECT)} FROM part", list(_PART)))
def q_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlations(table(spark, sf_dir, "part").selectExpr(*_PART_SELECT))


_LINE = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_pairs_sql("SELECT * FROM lineitem", _LINE))
def q_correlations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _correlations(table(spark, sf_dir, "lineitem").select(*_LINE))


def _wide_expressions(integer: str) -> dict[str, str]:
    """48 columns that are made from those of lineitem; every seventh has NULLs."""
    out = {}
    for i in range(48):
        whole = f"(l_partkey * {i + 1} + l_linenumber * {7 * i + 3} + CAST(l_quantity AS {integer}) * {i % 5}) % {50 + 3 * i}"
        value = f"CAST({whole} AS DOUBLE)" if i % 2 else f"{whole} + {1000000 * i}"
        out[f"w{i}"] = f"CASE WHEN l_orderkey % {i + 2} = 0 THEN NULL ELSE {value} END" if i % 7 == 3 else value
    return out


def _wide_sql() -> str:
    columns = ", ".join(f"{e} AS {n}" for n, e in _wide_expressions("BIGINT").items())
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, {columns} FROM lineitem),
        m AS MATERIALIZED (SELECT row, CAST(substr(name, 2) AS INTEGER) AS c, CAST(x AS DOUBLE) AS x FROM (
            SELECT row, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _wide_expressions("BIGINT"))} FROM d)
            UNPIVOT (x FOR name IN (COLUMNS(* EXCLUDE (row)))))
        SELECT 'w' || a.c AS left_column, 'w' || b.c AS right_column, round(corr(a.x, b.x), 6) AS correlation
        FROM m AS a JOIN m AS b ON a.row = b.row AND a.c < b.c GROUP BY a.c, b.c"""


@query(_wide_sql())
def q_correlations_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 1 128 pairs of 48 columns: co-moments are added up as matrices, no row is expanded by pairs."""
    columns = [f"{e} AS {n}" for n, e in _wide_expressions("BIGINT").items()]
    return _correlations(table(spark, sf_dir, "lineitem").selectExpr(*columns))


def _fences_sql(source: str, names: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, round(q1 - 1.5 * (q3 - q1), 4) AS lower_fence,
            round(q3 + 1.5 * (q3 - q1), 4) AS upper_fence,
            count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
            FROM d, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM d)
            GROUP BY q1, q3"""
        for c in names
    ]
    return f"WITH d AS ({source}) " + " UNION ALL ".join(parts)


@query(_fences_sql("SELECT event_id, user_id, value FROM events", ["event_id", "user_id", "value"]))
def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    rows = [row[1:] for row in outliers(df, column_statistics(df, distinct=False))]
    frame = spark.createDataFrame(rows, "column_name string, lower_fence double, upper_fence double, outlier_count bigint")
    return frame.withColumns({c: F.round(c, 4) for c in ("lower_fence", "upper_fence")})


@query(
    """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS rows FROM orders
       GROUP BY period ORDER BY period LIMIT 240"""
)
def q_trend_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_trend(table(spark, sf_dir, "orders"), "o_orderdate")


_METRIC = "round(avg({0}), 4) AS average, round(sum({0}), 2) AS total, count(*) AS rows"


@query(
    f"""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, {_METRIC.format('o_totalprice')} FROM orders
        GROUP BY period ORDER BY period LIMIT 240"""
)
def q_trend_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = monthly_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return trend.withColumns({"average": F.round("average", 4), "total": F.round("total", 2)})


_TEXT_DATE = """CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '2024' WHEN 2 THEN '2024-02'
    WHEN 3 THEN CAST(o_orderdate AS {0}) ELSE CAST(CAST(o_orderdate AS DATE) AS {0}) END"""


@query(
    f"""SELECT date_trunc('month', TRY_CAST({_TEXT_DATE.format('VARCHAR')} AS TIMESTAMP))::TIMESTAMP AS period,
        round(avg(o_custkey), 4) AS average, sum(o_custkey)::BIGINT AS total, count(*) AS rows FROM orders
        GROUP BY period HAVING period IS NOT NULL"""
)
def q_trend_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as text, some of them not dates; an integer metric; all months."""
    df = table(spark, sf_dir, "orders").withColumn("written", F.expr(_TEXT_DATE.format("STRING")))
    trend = monthly_trend(df, "written", "o_custkey")
    return trend.withColumns({"average": F.round("average", 4), "total": F.col("total").cast("bigint")})


_RESEARCHED = """user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value,
    2 * user_id + 1 AS twice"""
_NUMBERS = ("user_id", "value", "twice")


def _findings_sql() -> str:
    sparse = " + ".join(
        f"(SELECT CASE WHEN (count(*) - count({c})) / count(*) >= 0.2 THEN 1 ELSE 0 END FROM d)"
        for c in ("user_id", "event_type", "value", "twice")
    )
    strong = " + ".join(
        f"(SELECT CASE WHEN abs(corr({a}, {b})) >= 0.8 THEN 1 ELSE 0 END FROM d)" for a, b in combinations(_NUMBERS, 2)
    )
    outside = " + ".join(
        f"""(SELECT count(*) FROM d, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3
            FROM d) WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""
        for c in _NUMBERS
    )
    copies = "(SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))"
    return f"""WITH d AS (SELECT {_RESEARCHED} FROM events), f AS (
        SELECT 'missing_values' AS rule, ({sparse})::DOUBLE AS severity_value
        UNION ALL SELECT 'duplicate_rows', ({copies})::DOUBLE
        UNION ALL SELECT 'strong_correlation', ({strong})::DOUBLE
        UNION ALL SELECT 'outliers', ({outside})::DOUBLE) SELECT * FROM f WHERE severity_value > 0"""


@query(_findings_sql())
def q_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite operator; its findings sum up all other results."""
    df = table(spark, sf_dir, "events").selectExpr(
        "user_id",
        "event_type",
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value",
        "2 * user_id + 1 AS twice",
    )
    return research_dataset(df, "data quality").findings.select("rule", "severity_value")


_EARLY = "o_orderdate < TIMESTAMP '1998-01-01 00:00:00'"
_RIGHT = """o_orderkey, CAST(o_custkey AS {0}) AS o_custkey, o_orderstatus,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, 'x' AS extra"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    right = orders.where(~early).selectExpr(
        "o_orderkey",
        "CAST(o_custkey AS STRING) AS o_custkey",
        "o_orderstatus",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "o_orderdate",
        "'x' AS extra",
    )
    return orders.where(early), right


@query(
    f"""SELECT l AS left_rows, r AS right_rows, r - l AS difference, round((r - l) / l * 100, 4) AS percent_change
        FROM (SELECT count(*) FILTER (WHERE {_EARLY}) AS l, count(*) FILTER (WHERE NOT {_EARLY}) AS r FROM orders)"""
)
def q_compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_datasets(*_sides(spark, sf_dir)).rows


def _schema_sql() -> str:
    """Names, types and row counts of both sides, from the rows themselves."""
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    sides = (f"SELECT * FROM orders WHERE {_EARLY}", f"SELECT {_RIGHT.format('VARCHAR')} FROM orders WHERE NOT {_EARLY}")
    parts = []
    for side, source in zip(("l", "r"), sides):
        own = (*names, "o_orderpriority" if side == "l" else "extra")
        parts += [f"SELECT '{side}' AS s, '{c}' AS column_name, max(typeof({c})) AS type, count({c}) AS n FROM ({source})" for c in own]
    return f"""WITH c AS ({' UNION ALL '.join(parts)}),
        l AS (SELECT * FROM c WHERE s = 'l'), r AS (SELECT * FROM c WHERE s = 'r')
        SELECT coalesce(l.column_name, r.column_name) AS column_name, CASE WHEN r.s IS NULL THEN 'left_only'
               WHEN l.s IS NULL THEN 'right_only' ELSE 'shared' END AS side, coalesce(l.type <> r.type, false) AS type_changed,
               l.n AS left_present, r.n AS right_present
        FROM l FULL JOIN r ON l.column_name = r.column_name"""


@query(_schema_sql())
def q_compare_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = schema_drift(*_sides(spark, sf_dir))
    return diff.select(F.col("column").alias("column_name"), "side", "type_changed", "left_present", "right_present")


def _drift_sql() -> str:
    shared = ("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [
        f"""SELECT '{c}' AS column_name, a AS left_null_rate, b AS right_null_rate, round(b - a, 6) AS null_rate_delta,
            true AS distinct_within_tolerance FROM (
            SELECT round((SELECT (count(*) - count({c})) / count(*) FROM l), 6) AS a,
                   round((SELECT (count(*) - count({c})) / count(*) FROM r), 6) AS b)"""
        for c in shared
    ]
    sides = f"l AS (SELECT * FROM orders WHERE {_EARLY}), r AS (SELECT {_RIGHT.format('VARCHAR')} FROM orders WHERE NOT {_EARLY})"
    return f"WITH {sides} " + " UNION ALL ".join(parts)


@query(_drift_sql())
def q_compare_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rates of both sides; distinct estimates are checked against exact counts."""
    sides = _sides(spark, sf_dir)
    drift = compare_datasets(*sides).drift
    checked = drift
    for label, df in zip(("left", "right"), sides):
        exact = exact_distinct(df, df.schema.fields).withColumnRenamed("distinct_count", f"{label}_exact")
        checked = checked.join(exact, "column", "left")

    def close(label: str) -> Column:
        exact = F.col(f"{label}_exact")
        return F.abs(F.col(f"{label}_approximate_distinct") - exact) <= 5 * DISTINCT_ERROR * exact

    return checked.select(
        F.col("column").alias("column_name"),
        "left_null_rate",
        "right_null_rate",
        "null_rate_delta",
        (close("left") & close("right")).alias("distinct_within_tolerance"),
    )


def _overlap_sql(left: str, right: str, keys: list[str]) -> str:
    names = ", ".join(keys)
    join = " AND ".join(f"l.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    return f"""WITH l AS (SELECT DISTINCT {names} FROM ({left})), r AS (SELECT DISTINCT {names} FROM ({right}))
        SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct,
               (SELECT count(*) FROM l JOIN r ON {join}) AS intersection"""


@query(
    _overlap_sql(f"SELECT * FROM orders WHERE {_EARLY}", f"SELECT * FROM orders WHERE NOT {_EARLY}", ["o_custkey"])
)
def q_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    early = F.expr("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    return key_overlap(orders.where(early), orders.where(~early), ["o_custkey"]).drop("keys")


_NULL_SIDE = f"SELECT {_NULL_KEY} AS k, o_orderstatus FROM orders WHERE "


@query(_overlap_sql(_NULL_SIDE + _EARLY, f"{_NULL_SIDE}NOT ({_EARLY})", ["k", "o_orderstatus"]))
def q_key_overlap_multi_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    early = F.expr("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00'")
    left, right = (orders.where(c).selectExpr(f"{_NULL_KEY} AS k", "o_orderstatus") for c in (early, ~early))
    return key_overlap(left, right, ["k", "o_orderstatus", "k"]).drop("keys")


@query(
    _overlap_sql(
        f"SELECT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders WHERE {_EARLY}",
        f"SELECT CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders WHERE NOT {_EARLY}",
        ["o_custkey"],
    )
)
def q_key_overlap_type_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number on one side and text on the other: compared as text."""
    return key_overlap(*_sides(spark, sf_dir), ["o_custkey"]).drop("keys")


@query(
    """WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), r AS (SELECT DISTINCT c_custkey AS k FROM customer)
       SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct,
              (SELECT count(*) FROM l JOIN r USING (k)) AS intersection"""
)
def q_key_overlap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return key_overlap(left, right, ["k"]).drop("keys")


_MIXED = "CASE WHEN c_custkey % 2 = 0 THEN 9007199254740992 + c_custkey ELSE c_custkey END"


@query(
    f"""WITH l AS (SELECT DISTINCT {_MIXED} AS k FROM customer),
        r AS (SELECT DISTINCT CAST(o_custkey AS DOUBLE) + CASE o_custkey % 3 WHEN 0 THEN 0.5 ELSE 0 END AS k FROM orders)
        SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct,
               (SELECT count(*) FROM l JOIN (SELECT CAST(k AS BIGINT) AS k FROM r WHERE k = floor(k)) USING (k)) AS intersection"""
)
def q_key_overlap_numeric_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit integers beyond what a double holds, against doubles: compared by their digits."""
    left = table(spark, sf_dir, "customer").selectExpr(f"{_MIXED} AS k")
    right = table(spark, sf_dir, "orders").selectExpr("CAST(o_custkey AS DOUBLE) + IF(o_custkey % 3 = 0, 0.5D, 0D) AS k")
    return key_overlap(left, right, ["k"]).drop("keys")


_FAR_LEFT = "1152921504606846976 + c_custkey * 64"


@query(
    f"""WITH l AS (SELECT DISTINCT CAST({_FAR_LEFT} AS HUGEINT) AS k FROM customer),
        r AS (SELECT DISTINCT CAST(1152921504606846976::DOUBLE + o_custkey * 256 AS HUGEINT) AS k FROM orders)
        SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct,
               (SELECT count(*) FROM l JOIN r USING (k)) AS intersection"""
)
def q_key_overlap_far_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit integers around 2**60 against the doubles there: only every fourth integer is a double."""
    left = table(spark, sf_dir, "customer").selectExpr(f"{_FAR_LEFT} AS k")
    right = table(spark, sf_dir, "orders").selectExpr("CAST(1152921504606846976 AS DOUBLE) + o_custkey * 256 AS k")
    return key_overlap(left, right, ["k"]).drop("keys")


_FAR_DECIMAL = """CASE WHEN c_custkey % 2 = 0 THEN CAST(100000000000000000000 + c_custkey * 16384 AS DECIMAL(38,10))
    ELSE CAST(c_custkey * CAST(0.0000001 AS DECIMAL(10,7)) AS DECIMAL(38,10)) END"""
_FAR_DOUBLE = "CASE WHEN o_custkey % 2 = 0 THEN 1e20 + o_custkey * 16384 ELSE o_custkey / 1e7 END"


@query(
    f"""WITH l AS (SELECT DISTINCT CASE WHEN k >= 1 THEN CAST(CAST(k AS HUGEINT) AS VARCHAR) ELSE CAST(CAST(k AS DOUBLE) AS VARCHAR) END AS k
                   FROM (SELECT {_FAR_DECIMAL.replace("100000000000000000000", "100000000000000000000::HUGEINT")} AS k FROM customer)),
        r AS (SELECT DISTINCT CASE WHEN k >= 1 THEN CAST(CAST(k AS HUGEINT) AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS k
              FROM (SELECT {_FAR_DOUBLE} AS k FROM orders))
        SELECT (SELECT count(*) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS right_distinct,
               (SELECT count(*) FROM l JOIN r USING (k)) AS intersection"""
)
def q_key_overlap_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals of 1e20 and of 1e-7 against doubles."""
    left = table(spark, sf_dir, "customer").selectExpr(f"{_FAR_DECIMAL.replace('100000000000000000000', '100000000000000000000BD')} AS k")
    right = table(spark, sf_dir, "orders").selectExpr(f"{_FAR_DOUBLE.replace('1e20', '1e20D').replace('1e7', '1e7D')} AS k")
    return key_overlap(left, right, ["k"]).drop("keys")
