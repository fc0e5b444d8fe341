"""Profiles: counts, moments, quartiles, distinct and frequent values, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.functions.hashing import portable_row_hash
from dataproof.operators.frequencies import exact_distinct, top_values
from dataproof.operators.profile import DISTINCT_ERROR, column_statistics, profile_dataset, stable_sample
from dataproof.operators.quantiles import RELATIVE_ERROR, approximate_quantiles
from dataproof.queries.registry import query, table

_NUMERIC = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)
_WITH_NULLS = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"


def _numeric_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = [c for c in _NUMERIC if c != "l_quantity"]
    return table(spark, sf_dir, "lineitem").select(*others, F.expr(_WITH_NULLS).alias("l_quantity"))


def _numeric_sql() -> str:
    source = f"SELECT * REPLACE ({_WITH_NULLS} AS l_quantity) FROM lineitem"
    parts = [
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) / count(*), 6) AS null_rate,
            min({c}::DOUBLE) AS minimum, max({c}::DOUBLE) AS maximum, round(avg({c}::DOUBLE), 4) AS mean,
            round(stddev_pop({c}::DOUBLE), 4) AS standard_deviation,
            round(quantile_cont({c}::DOUBLE, 0.25), 4) AS first_quartile,
            round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
            round(quantile_cont({c}::DOUBLE, 0.75), 4) AS third_quartile FROM d"""
        for c in _NUMERIC
    ]
    return f"WITH d AS ({source}) " + " UNION ALL ".join(parts)


@query(_numeric_sql())
def q_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numeric_lineitem(spark, sf_dir)
    statistics = column_statistics(df, distinct=False).frame(df)
    return statistics.select(
        F.col("column").alias("column_name"),
        "null_count",
        "null_rate",
        F.col("min_number").alias("minimum"),
        F.col("max_number").alias("maximum"),
        *[
            F.round(c, 4).alias(c)
            for c in ("mean", "standard_deviation", "first_quartile", "median", "third_quartile")
        ],
    )


@query(
    """SELECT 'orders' AS table_name, 'o_orderdate' AS column_name, min(o_orderdate)::VARCHAR AS minimum,
              max(o_orderdate)::VARCHAR AS maximum FROM orders
       UNION ALL SELECT 'lineitem', 'l_shipdate', min(l_shipdate)::VARCHAR, max(l_shipdate)::VARCHAR FROM lineitem
       UNION ALL SELECT 'events', 'ts', min(ts)::VARCHAR, max(ts)::VARCHAR FROM events"""
)
def q_profile_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")):
        df = table(spark, sf_dir, name).select(column)
        frame = column_statistics(df, distinct=False, quantiles=False).frame(df)
        parts.append(frame.select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "minimum", "maximum"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM orders" for c in _ORDERS))
def q_profile_distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return exact_distinct(df, df.schema.fields).withColumnRenamed("column", "column_name")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, true AS within_tolerance FROM orders"
        for c in _ORDERS
    )
)
def q_profile_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates next to exact counts: within five standard errors of the sketch."""
    df = table(spark, sf_dir, "orders")
    estimated = column_statistics(df, moments=False).frame(df).select("column", "approximate_distinct")
    exact = exact_distinct(df, df.schema.fields)
    error = F.abs(F.col("approximate_distinct") - F.col("distinct_count")) / F.col("distinct_count")
    return exact.join(F.broadcast(estimated), "column").select(
        F.col("column").alias("column_name"), "distinct_count", (error <= 5 * DISTINCT_ERROR).alias("within_tolerance")
    )


def _top_sql(source: str, columns: Sequence[str], k: int = 10) -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, row_number() OVER (ORDER BY n DESC, value ASC NULLS LAST)::INTEGER AS position,
            value, n AS occurrences FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY {c})
            QUALIFY position <= {k}"""
        for c in columns
    ]
    return f"WITH d AS ({source}) " + " UNION ALL ".join(parts)


def _top(df: DataFrame) -> DataFrame:
    return top_values(df, df.schema.fields).select(
        F.col("column").alias("column_name"),
        F.col("rank").cast("int").alias("position"),
        "value",
        F.col("count").alias("occurrences"),
    )


_NULL_KEYS = "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey"


@query(
    _top_sql(
        f"SELECT o_orderstatus, o_orderpriority, {_NULL_KEYS}, o_orderdate FROM orders",
        ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate"],
    )
)
def q_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("o_orderstatus", "o_orderpriority", _NULL_KEYS, "o_orderdate")
    return _top(df)


_RENDERED = "l_discount, l_quantity, l_extendedprice, l_extendedprice * 1e6 AS large, l_tax / 100000 AS small"


@query(
    _top_sql(
        f"SELECT {_RENDERED} FROM lineitem", ["l_discount", "l_quantity", "l_extendedprice", "large", "small"]
    )
)
def q_top_values_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional values are ordered and shown by their rendering, with and without exponents."""
    return _top(table(spark, sf_dir, "lineitem").selectExpr(*[part.strip() for part in _RENDERED.split(",")]))


_SAMPLE = "c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment"


def _hash_sql(*columns: str) -> str:
    cells = [
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in columns
    ]
    return f"md5(concat({', '.join(cells)}))"


@query(
    f"""SELECT * FROM (SELECT {_SAMPLE} FROM customer)
        ORDER BY {_hash_sql('c_custkey', 'c_name', 'c_mktsegment')} LIMIT 20"""
)
def q_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", _SAMPLE.split(", ", 2)[2])
    return stable_sample(df, row_hash="portable")


_HASHED = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")


@query(f"SELECT l_orderkey, l_linenumber, {_hash_sql(*_HASHED)} AS row_hash FROM lineitem")
def q_row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*_HASHED)
    return df.select("l_orderkey", "l_linenumber", portable_row_hash(df.schema.fields).alias("row_hash"))


_PROFILED = ("user_id", "event_type", "value")
_PROFILED_SOURCE = "SELECT user_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events"


def _profile_sql() -> str:
    parts = []
    for c in _PROFILED:
        numeric = c != "event_type"
        value = f"{c}::DOUBLE" if numeric else "NULL::DOUBLE"
        parts.append(
            f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
                round((count(*) - count({c})) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS distinct_count,
                round(avg({value}), 4) AS mean, round(quantile_cont({value}, 0.5), 4) AS median,
                (SELECT string_agg(coalesce(value, '(null)') || '=' || n, ',' ORDER BY n DESC, value ASC NULLS LAST)
                 FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM d GROUP BY {c}
                       ORDER BY n DESC, value ASC NULLS LAST LIMIT 10)) AS top_values FROM d"""
        )
    return f"WITH d AS ({_PROFILED_SOURCE}) " + " UNION ALL ".join(parts)


@query(_profile_sql())
def q_profile_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite operator: one row per column, frequent values included."""
    df = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_type", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value"
    )
    profile = profile_dataset(df, distinct="exact")
    shown = F.transform(
        "top_values", lambda v: F.concat(F.coalesce(v["value"], F.lit("(null)")), F.lit("="), v["count"].cast("string"))
    )
    return profile.columns.crossJoin(F.broadcast(profile.summary)).select(
        F.col("column").alias("column_name"),
        "row_count",
        "null_count",
        "null_rate",
        "distinct_count",
        F.round("mean", 4).alias("mean"),
        F.round("median", 4).alias("median"),
        F.array_join(shown, ",").alias("top_values"),
    )


@query(
    """SELECT 'vec_id' AS column_name, count(*) AS row_count, count(*) - count(vec_id) AS null_count, true AS distinct_within_tolerance,
              3 AS column_count, 20 AS sample_rows FROM embeddings
       UNION ALL SELECT 'embedding', count(*), count(*) - count(embedding), true, 3, 20 FROM embeddings
       UNION ALL SELECT 'label', count(*), count(*) - count(label), true, 3, 20 FROM embeddings"""
)
def q_profile_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a list column: profiled without frequent values, sampled by its full rows."""
    df = table(spark, sf_dir, "embeddings")
    profile = profile_dataset(df)
    sampled = profile.sample.agg(F.count(F.lit(1)).cast("int").alias("sample_rows"))
    keys = [F.struct(F.lit(name).alias("column_name"), F.xxhash64(name).alias("h")) for name in ("vec_id", "embedding", "label")]
    exact = df.select(F.explode(F.array(*keys)).alias("k")).groupBy("k.column_name").agg(F.countDistinct("k.h").alias("exact"))
    close = F.abs(F.col("approximate_distinct") - F.col("exact")) <= 5 * DISTINCT_ERROR * F.col("exact")
    found = profile.columns.select(F.col("column").alias("column_name"), "null_count", "approximate_distinct").join(exact, "column_name")
    return found.join(profile.summary).join(sampled).select(
        "column_name", "row_count", "null_count", close.alias("distinct_within_tolerance"), "column_count", "sample_rows"
    )


_SPREAD = {
    "price": "l_extendedprice",
    "around_zero": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice - 30000 END",
    "small": "l_tax * 1e-200",
    "large": "-l_quantity * 1e200",
    "whole": "l_orderkey",
}


def _approximate_sql() -> str:
    """Order statistics as the middles of their buckets: equal steps between powers of two."""
    parts = []
    for name, expression in _SPREAD.items():
        picked = ", ".join(
            f"max(CASE WHEN r = {side}({p} * (n - 1)) THEN middle END) AS {side}{i}, any_value({p} * (n - 1) - floor({p} * (n - 1))) AS part{i}"
            if side == "floor"
            else f"max(CASE WHEN r = {side}({p} * (n - 1)) THEN middle END) AS {side}{i}"
            for i, p in enumerate((0.25, 0.5, 0.75))
            for side in ("floor", "ceil")
        )
        quartiles = ", ".join(
            f"floor{i} + (ceil{i} - floor{i}) * part{i} AS {q}" for i, q in enumerate(("first_quartile", "median", "third_quartile"))
        )
        parts.append(f"""SELECT '{name}' AS column_name, {quartiles}, true AS within_error, true AS repeatable FROM (SELECT {picked} FROM (
            SELECT r, n, CASE WHEN x = 0 THEN 0 ELSE sign(x) * pow(2.0, e) * (1 + (floor((abs(x) / pow(2.0, e) - 1) * 256) + 0.5) / 256) END AS middle
            FROM (SELECT x, r, n, g + CASE WHEN abs(x) / pow(2.0, g) >= 2 THEN 1 WHEN abs(x) / pow(2.0, g) < 1 THEN -1 ELSE 0 END AS e
                  FROM (SELECT x, floor(log2(nullif(abs(x), 0))) AS g, row_number() OVER (ORDER BY x) - 1 AS r, count(*) OVER () AS n
                        FROM (SELECT CAST({expression} AS DOUBLE) AS x FROM lineitem) WHERE x IS NOT NULL))))""")
    return " UNION ALL ".join(parts)


@query(_approximate_sql())
def q_quartiles_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from exact counts of buckets: near the exact ones, and the same however the rows are dealt."""
    df = table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _SPREAD.items()])
    names = list(_SPREAD)
    found = approximate_quantiles(df, names)
    again = [approximate_quantiles(df.repartition(parts), names) for parts in (3, 16)]
    exact = column_statistics(df, distinct=False)
    rows = []
    for name in names:
        record = exact.record(name)
        true = [record[q] for q in ("first_quartile", "median", "third_quartile")]
        near = all(abs(a - b) <= RELATIVE_ERROR * max(abs(a), abs(b)) * 1.01 for a, b in zip(found[name], true))
        rows.append((name, *found[name], near, all(other[name] == found[name] for other in again)))
    schema = "column_name string, first_quartile double, median double, third_quartile double, within_error boolean, repeatable boolean"
    return spark.createDataFrame(rows, schema)
