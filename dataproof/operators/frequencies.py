"""How often each value of each column occurs: one scan and one shuffle for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.rendering import plain_text, render, shortest_text
from dataproof.functions.types import column, is_fractional, is_integral
from dataproof.plans.two_level import melt


def _lane_type(dtype: T.DataType) -> T.DataType:
    return T.LongType() if is_integral(dtype) else dtype


def value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> tuple[DataFrame, list[tuple[str, T.DataType]]]:
    """``(position, one lane per value type, count)`` and the lanes.

    Every row becomes one narrow row per column. A value stays in its own type, in the lane
    of that type, so that nothing is rendered before the counting. Equal values are added up
    in each task before the shuffle, which also takes the weight off a value that fills a
    third of a column.
    """
    types: list[T.DataType] = []
    for f in fields:
        if _lane_type(f.dataType) not in types:
            types.append(_lane_type(f.dataType))
    lanes = [(f"lane{i}", dtype) for i, dtype in enumerate(types)]
    cells = [
        [
            (column(f.name) if _lane_type(f.dataType) == dtype else F.lit(None)).cast(dtype).alias(lane)
            for lane, dtype in lanes
        ]
        for f in fields
    ]
    melted = melt(df, cells)
    names = [lane for lane, _ in lanes]
    return melted.groupBy("position", *names).agg(F.count(F.lit(1)).alias("count")), lanes


def _with_text(counts: DataFrame, lanes: Sequence[tuple[str, T.DataType]]) -> DataFrame:
    """Replace the lanes by the rendered ``value``.

    Fractional lanes are rendered in steps, each a column of its own: as one expression the
    text of a number would be made anew in every place that looks at it.
    """
    fractional = [lane for lane, dtype in lanes if is_fractional(dtype)]
    texts = {f"{lane}_text": F.col(lane).cast("string") for lane in fractional}
    shortest = {f"{lane}_text": shortest_text(F.col(lane), F.col(f"{lane}_text")) for lane in fractional}
    steps = counts.withColumns(texts).withColumns(shortest) if fractional else counts
    value = F.coalesce(
        *[
            F.when(F.col(lane).isNotNull(), plain_text(F.col(lane), F.col(f"{lane}_text")))
            if lane in fractional
            else render(F.col(lane), dtype)
            for lane, dtype in lanes
        ]
    )
    return steps.select("position", value.alias("value"), "count")


def top_values(df: DataFrame, fields: Sequence[T.StructField], k: int = 10) -> DataFrame:
    """The k most frequent values per column; NULL is a value, ties go by rendered text.

    ``row_number() <= k`` is evaluated per task before the window's shuffle, so only k rows
    per column and task reach the ranking.
    """
    counts, lanes = value_counts(df, fields)
    by_column = Window.partitionBy("position").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return (
        _with_text(counts, lanes)
        .withColumn("rank", F.row_number().over(by_column))
        .where(F.col("rank") <= k)
        .select(_name_of(fields).alias("column"), "rank", "value", "count")
    )


def exact_distinct(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Exact number of distinct non-null values per column, from the same counting shuffle."""
    counts, lanes = value_counts(df, fields)
    present = F.coalesce(*[F.col(lane).isNotNull() for lane, _ in lanes], F.lit(False)) if len(lanes) == 1 else (
        F.greatest(*[F.col(lane).isNotNull() for lane, _ in lanes])
    )
    per_column = counts.groupBy("position").agg(F.count_if(present).alias("distinct_count"))
    return per_column.select(_name_of(fields).alias("column"), "distinct_count")


def _name_of(fields: Sequence[T.StructField]) -> Column:
    return F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("position"))
