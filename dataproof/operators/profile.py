"""Column profiles: counts, extremes, moments, quartiles, frequent values, a stable sample."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.hashing import order_hash, value_hash
from dataproof.functions.rendering import finite, render, render_apart
from dataproof.functions.types import column, is_fractional, is_groupable, is_integral, is_numeric, is_temporal
from dataproof.operators.frequencies import exact_distinct, top_values
from dataproof.operators.quantiles import (
    QUARTILES,
    approximate_quantiles,
    bracket_ranks,
    exact_quantiles,
    merge_sketches,
    sketch,
    sketch_count,
    sketch_quantiles,
)
from dataproof.plans.compiled import small_methods
from dataproof.plans.two_level import aggregate_two_level, melt

TOP_K = 10
SAMPLE_ROWS = 20
# Standard error of distinct estimates.
DISTINCT_ERROR = 0.05

STATISTICS_SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("nullable", T.BooleanType(), False),
        T.StructField("null_count", T.LongType(), False),
        T.StructField("null_rate", T.DoubleType(), False),
        T.StructField("approximate_distinct", T.LongType(), True),
        T.StructField("minimum", T.StringType(), True),
        T.StructField("maximum", T.StringType(), True),
        T.StructField("min_number", T.DoubleType(), True),
        T.StructField("max_number", T.DoubleType(), True),
        T.StructField("mean", T.DoubleType(), True),
        T.StructField("standard_deviation", T.DoubleType(), True),
        T.StructField("first_quartile", T.DoubleType(), True),
        T.StructField("median", T.DoubleType(), True),
        T.StructField("third_quartile", T.DoubleType(), True),
    ]
)


@dataclass(frozen=True)
class Statistics:
    """Row count and one record per analysed column: a few kilobytes, held by the driver."""

    row_count: int
    fields: tuple[T.StructField, ...]
    records: tuple[dict, ...]

    def record(self, name: str) -> dict:
        return next(record for record in self.records if record["column"] == name)

    def frame(self, df: DataFrame) -> DataFrame:
        names = STATISTICS_SCHEMA.names
        rows = [tuple(record[name] for name in names) for record in self.records]
        return df.sparkSession.createDataFrame(rows, STATISTICS_SCHEMA)


@dataclass(frozen=True)
class Profile:
    """``summary`` has one row, ``columns`` one per analysed column, ``sample`` up to 20."""

    summary: DataFrame
    columns: DataFrame
    top_values: DataFrame
    sample: DataFrame
    warnings: tuple[str, ...]
    statistics: Statistics


def rate(part: int, whole: int, digits: int = 6) -> float:
    return round(part / whole, digits) if whole else 0.0


def _order_lanes(fields: Sequence[T.StructField]) -> list[tuple[str, T.DataType]]:
    """One lane per type whose extremes a double would not keep exactly."""
    types: list[T.DataType] = []
    for f in fields:
        dtype = _lane_type(f.dataType)
        if dtype is not None and dtype not in types:
            types.append(dtype)
    return [(f"lane{i}", dtype) for i, dtype in enumerate(types)]


def _lane_type(dtype: T.DataType) -> T.DataType | None:
    if is_integral(dtype):
        return T.LongType()
    return dtype if isinstance(dtype, T.DecimalType) or is_temporal(dtype) else None


def _scalar_frame(df: DataFrame, fields: Sequence[T.StructField], moments: bool) -> DataFrame:
    """One row per column position: counts, extremes, mean and spread in generated code; few rows are rendered."""
    if not moments:
        return _count_frame(df, fields)
    lanes = _order_lanes(fields)
    cells = []
    for f in fields:
        value = column(f.name)
        cell = [value.isNotNull().alias("present")]
        cell.append((value if is_numeric(f.dataType) else F.lit(None)).cast("double").alias("number"))
        cell += [
            (value if _lane_type(f.dataType) == dtype else F.lit(None)).cast(dtype).alias(lane) for lane, dtype in lanes
        ]
        cells.append(cell)
    aggregates = [F.count(F.lit(1)).alias("rows"), F.count_if("present").alias("present")]
    for name in ("number", *[lane for lane, _ in lanes]):
        aggregates += [F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}")]
    aggregates += [F.avg("number").alias("mean"), F.stddev_pop("number").alias("std")]
    merged = melt(df, cells).groupBy("position").agg(*aggregates)

    def extreme_text(which: str) -> Column:
        text = render_apart(F.col(f"{which}_number"), T.DoubleType())
        fractional = F.when(_is_fractional_position(fields), text)
        return F.coalesce(fractional, *[render(F.col(f"{which}_{lane}"), dtype) for lane, dtype in lanes])

    return merged.select(
        "position",
        "rows",
        "present",
        extreme_text("min").alias("minimum"),
        extreme_text("max").alias("maximum"),
        *[finite(F.col(name)).alias(name) for name in ("min_number", "max_number", "mean", "std")],
    )


def _count_frame(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row per column position: counts only, a single one per column, for which rows need not become cells."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(column(f.name)).alias(f"count{i}") for i, f in enumerate(fields)])
    return melt(counted, [[F.col("rows"), F.col(f"count{i}").alias("present")] for i in range(len(fields))])


def _distinct_frame(df: DataFrame, fields: Sequence[T.StructField], error: float) -> DataFrame:
    """One row per column position: the estimated number of distinct values.

    The estimate is a function of the values alone; merging the registers of the tasks gives
    the same one in any partitioning. It is not generated code, so it gets a plan of its own
    instead of slowing down the other aggregates.
    """
    cells = [[value_hash(column(f.name), f.dataType).alias("hash")] for f in fields]
    return melt(df, cells).groupBy("position").agg(F.approx_count_distinct("hash", error).alias("distinct"))


def _bracket_frame(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One row per numeric column position: its sketch at the ranks the quartiles need."""
    cells = [
        [F.lit(i).alias("field"), column(f.name).cast("double").alias("number")]
        for i, f in enumerate(fields)
        if is_numeric(f.dataType)
    ]
    numbers = melt(df, cells).where(F.col("number").isNotNull()).select("field", "number")
    merged = aggregate_two_level(
        numbers, [sketch(F.col("number")).alias("sketch")], [merge_sketches(F.col("sketch")).alias("sketch")], ["field"]
    )
    return merged.select(
        F.col("field").alias("position"),
        sketch_count(F.col("sketch")).alias("real"),
        sketch_quantiles(F.col("sketch"), bracket_ranks(QUARTILES)).alias("bracket"),
    )


def _is_fractional_position(fields: Sequence[T.StructField]) -> Column:
    return F.col("position").isin([i for i, f in enumerate(fields) if is_fractional(f.dataType)])


def column_statistics(
    df: DataFrame,
    *,
    max_columns: int | None = None,
    distinct: bool = True,
    moments: bool = True,
    quantiles: bool = True,
    approx_quantiles: bool = False,
    distinct_error: float = DISTINCT_ERROR,
) -> Statistics:
    """All scalar statistics of all columns, or of the first ``max_columns`` if that is given.

    One job computes everything but the quartiles; exact quartiles take at least one more.
    ``approx_quantiles`` takes one, and gives the same result in every run, within a relative error of 1/512. The
    number of jobs does not depend on the number of columns.
    """
    quantiles = quantiles and moments
    fields = tuple(df.schema.fields[:max_columns])
    parts = [_scalar_frame(df, fields, moments)] if fields else []
    if fields and distinct:
        parts.append(_distinct_frame(df, fields, distinct_error))
    if quantiles and not approx_quantiles and any(is_numeric(f.dataType) for f in fields):
        parts.append(_bracket_frame(df, fields))
    # One job: the aggregations run side by side and end in a few rows per column.
    with nullcontext() if moments else small_methods(df.sparkSession):
        collected = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).collect() if parts else []
    rows: list[dict] = [{"present": 0, "distinct": 0 if distinct else None, "real": 0} for _ in fields]
    for row in collected:
        rows[row["position"]] |= {key: value for key, value in row.asDict().items() if value is not None}
    row_count = max((row.get("rows", 0) for row in rows), default=0) if fields else df.count()
    quartiles: dict[str, list[float | None]] = {}
    if quantiles and approx_quantiles:
        quartiles = approximate_quantiles(df, [f.name for f in fields if is_numeric(f.dataType)])
    elif quantiles:
        wanted = [(f.name, r["present"], r["real"], r["bracket"]) for f, r in zip(fields, rows) if r["real"]]
        quartiles = exact_quantiles(df, wanted)
    records = []
    for i, (f, r) in enumerate(zip(fields, rows)):
        nulls = row_count - r["present"]
        q1, median, q3 = quartiles.get(f.name, [None, None, None])
        records.append(
            {
                "ordinal": i,
                "column": f.name,
                "type": f.dataType.simpleString(),
                "nullable": f.nullable,
                "null_count": nulls,
                "null_rate": rate(nulls, row_count),
                "approximate_distinct": r["distinct"],
                "minimum": r.get("minimum"),
                "maximum": r.get("maximum"),
                "min_number": r.get("min_number"),
                "max_number": r.get("max_number"),
                "mean": r.get("mean"),
                "standard_deviation": r.get("std"),
                "first_quartile": q1,
                "median": median,
                "third_quartile": q3,
            }
        )
    return Statistics(row_count, fields, tuple(records))


def stable_sample(df: DataFrame, rows: int = SAMPLE_ROWS, row_hash: str = "fast") -> DataFrame:
    """The first rows in hash order: the same rows whatever the order or partitioning of the input.

    Equal hashes are equal rows, so ties cannot change the result. Each task keeps its own
    first rows (``TakeOrderedAndProject``), nothing is sorted as a whole. ``portable`` hashes
    give a sample that another engine can reproduce, and cost a rendering of every value.
    """
    keys = [key.asc() for key in order_hash(df.schema.fields, row_hash)]
    return df.orderBy(*keys).limit(rows)


def profile_dataset(
    df: DataFrame,
    *,
    max_columns: int | None = None,
    top_k: int = TOP_K,
    sample_rows: int = SAMPLE_ROWS,
    distinct: str = "approximate",
    approx_quantiles: bool = False,
    row_hash: str = "fast",
    max_distinct_rate: float | None = None,
) -> Profile:
    """Profile a dataset. Statistics are computed here; frequent values and sample stay lazy.

    ``max_distinct_rate`` leaves columns out of the frequent values whose estimated distinct values
    are a larger part of the rows: their values are all rare, and counting them shuffles them whole.
    ``distinct="exact"`` replaces the estimates of groupable columns by exact counts.
    """
    if distinct not in ("approximate", "exact"):
        raise ValueError(f"Unknown distinct mode: {distinct}")
    statistics = column_statistics(df, max_columns=max_columns, approx_quantiles=approx_quantiles)
    total = len(df.schema.fields)
    warnings = []
    if total > len(statistics.fields):
        warnings.append(f"Profiled {len(statistics.fields)} of {total} columns, as asked.")
    frame = statistics.frame(df)
    groupable = [f for f in statistics.fields if is_groupable(f.dataType)]
    if max_distinct_rate is not None:
        most = max_distinct_rate * statistics.row_count
        unique = [f.name for f in groupable if statistics.record(f.name)["approximate_distinct"] > most]
        groupable = [f for f in groupable if f.name not in unique]
        if unique:
            warnings.append(f"No frequent values of nearly unique columns, as asked: {', '.join(unique)}.")
    empty_top = "column string, rank int, value string, count bigint"
    top = top_values(df, groupable, top_k) if groupable else df.sparkSession.createDataFrame([], empty_top)
    if distinct == "exact" and groupable:
        exact = exact_distinct(df, groupable)
        counted = F.col("column").isin([f.name for f in groupable])
        frame = frame.join(exact, "column", "left").withColumn(
            "distinct_count", F.when(counted, F.coalesce("distinct_count", F.lit(0)))
        )
    lists = top.groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("ranked")
    )
    # Texts have no length limit, so the sizes decide how this is joined.
    columns = (
        frame.join(lists, "column", "left")
        .withColumn("top_values", F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count"))))
        .drop("ranked")
        .orderBy("ordinal")
    )
    shown = [*STATISTICS_SCHEMA.names, *[c for c in columns.columns if c == "distinct_count"]]
    summary = df.sparkSession.createDataFrame(
        [(statistics.row_count, total)], "row_count bigint, column_count int"
    )
    return Profile(
        summary=summary,
        columns=columns.select(*shown, "top_values"),
        top_values=top,
        sample=stable_sample(df, sample_rows, row_hash),
        warnings=tuple(warnings),
        statistics=statistics,
    )
