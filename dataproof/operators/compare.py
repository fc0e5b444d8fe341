"""Two datasets side by side: rows, schema, null and distinct drift, shared keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.numbers import numeric_key
from dataproof.functions.rendering import render
from dataproof.functions.types import column, field_of, is_chart_temporal, is_fractional, is_numeric
from dataproof.operators.profile import Statistics, column_statistics
from dataproof.plans.two_level import melt

MAX_KEYS = 8

_SCHEMA_DIFF = "column string, side string, left_type string, right_type string, type_changed boolean"
_DRIFT = (
    "column string, left_null_rate double, right_null_rate double, null_rate_delta double, "
    "left_approximate_distinct bigint, right_approximate_distinct bigint"
)
_ROWS = "left_rows bigint, right_rows bigint, difference bigint, percent_change double"


@dataclass(frozen=True)
class Comparison:
    rows: DataFrame
    schema: DataFrame
    drift: DataFrame
    key_overlap: DataFrame | None
    warnings: tuple[str, ...]


def _type_names(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per column name of either side: ``shared``, ``left_only`` or ``right_only``.

    Names are compared case-sensitively. Only the two schemas are looked at.
    """
    lt, rt = _type_names(left), _type_names(right)
    rows = []
    for name in sorted(lt.keys() | rt.keys()):
        side = "shared" if name in lt and name in rt else "left_only" if name in lt else "right_only"
        rows.append((name, side, lt.get(name), rt.get(name), side == "shared" and lt[name] != rt[name]))
    return left.sparkSession.createDataFrame(rows, _SCHEMA_DIFF)


def schema_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """:func:`schema_diff` with the rows of either side that have a value in the column (``left_present``, ``right_present``).

    One scan of each side: every row is one narrow row per column, counted in its task.
    """
    diff = schema_diff(left, right)
    for label, df in (("left", left), ("right", right)):
        names = F.array(*[F.lit(f.name) for f in df.schema.fields])
        cells = [[column(f.name).isNotNull().alias("present")] for f in df.schema.fields]
        counts = melt(df, cells).groupBy("position").agg(F.count_if("present").alias(f"{label}_present"))
        counts = counts.select(F.get(names, F.col("position")).alias("column"), f"{label}_present")
        # A row per column.
        diff = diff.join(F.broadcast(counts), "column", "left")
        on_side = F.col("side").isin("shared", f"{label}_only")
        diff = diff.withColumn(f"{label}_present", F.when(on_side, F.coalesce(f"{label}_present", F.lit(0))))
    return diff


def _key_pair(lf: T.StructField, rf: T.StructField) -> tuple[Column, Column, str | None]:
    """The two sides of one key in a common type.

    A double cannot hold every 64-bit integer or decimal, so a fractional and another numeric side
    are compared by their digits (:func:`numeric_key`), and so are decimals for which no type holds both.
    Timestamps with and without a zone are compared as text.
    """
    l, r = column(lf.name), column(rf.name)
    lt, rt = lf.dataType, rf.dataType
    if lt == rt or (is_chart_temporal(lt) and is_chart_temporal(rt) and not _zones_differ(lt, rt)):
        return l, r, None
    if is_numeric(lt) and is_numeric(rt):
        if is_fractional(lt) == is_fractional(rt) and not _too_wide(lt, rt):
            return l, r, None
        return numeric_key(l, lt), numeric_key(r, rt), None
    note = f"{lf.name}: {lt.simpleString()} against {rt.simpleString()}, so the texts are compared."
    return render(l, lt), render(r, rt), note


def _too_wide(lt: T.DataType, rt: T.DataType) -> bool:
    """Whether the common type of two exact numbers would have to round one of them."""
    whole, scale = (max(x) for x in zip(*[(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in (lt, rt)]))
    return isinstance(lt, T.DecimalType) | isinstance(rt, T.DecimalType) and whole + scale > 38


def _zones_differ(lt: T.DataType, rt: T.DataType) -> bool:
    return {type(lt), type(rt)} == {T.TimestampType, T.TimestampNTZType}


def _unique_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    unique = list(dict.fromkeys(keys))
    if not unique or len(unique) > MAX_KEYS:
        raise ValueError(f"1 to {MAX_KEYS} keys are needed")
    for key in unique:
        if key not in left.columns or key not in right.columns:
            raise ValueError(f"Only one side has the key {key}")
    return unique


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key tuples on the left, on the right, and on both sides. NULL equals NULL.

    Both sides are tagged, put together and grouped once, instead of two ``distinct`` and a
    join. A hot key shrinks to one row per task before the shuffle.
    """
    unique = _unique_keys(left, right, keys)
    pairs = [_key_pair(field_of(left, key), field_of(right, key)) for key in unique]
    names = [f"key{i}" for i in range(len(unique))]
    left_keys = left.select(
        *[l.alias(n) for n, (l, _, _) in zip(names, pairs)], F.lit(1).alias("in_left"), F.lit(0).alias("in_right")
    )
    right_keys = right.select(
        *[r.alias(n) for n, (_, r, _) in zip(names, pairs)], F.lit(0).alias("in_left"), F.lit(1).alias("in_right")
    )
    sides = left_keys.unionAll(right_keys).groupBy(*names).agg(
        F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right")
    )
    zero = F.lit(0)
    return sides.agg(
        F.coalesce(F.sum("in_left"), zero).cast("bigint").alias("left_distinct"),
        F.coalesce(F.sum("in_right"), zero).cast("bigint").alias("right_distinct"),
        F.coalesce(F.sum(F.col("in_left") * F.col("in_right")), zero).cast("bigint").alias("intersection"),
    ).select(F.array(*[F.lit(key) for key in unique]).alias("keys"), "left_distinct", "right_distinct", "intersection")


def percent_change(left: int, right: int) -> float | None:
    return round((right - left) / left * 100, 4) if left else None


def _drift_rows(left: Statistics, right: Statistics, shared: Sequence[str]) -> list[tuple]:
    l = {record["column"]: record for record in left.records}
    r = {record["column"]: record for record in right.records}
    rows = []
    for name in shared:
        a, b = l[name], r[name]
        rows.append(
            (
                name,
                a["null_rate"],
                b["null_rate"],
                round(b["null_rate"] - a["null_rate"], 6),
                a["approximate_distinct"],
                b["approximate_distinct"],
            )
        )
    return rows


def compare_datasets(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), *, max_columns: int | None = None
) -> Comparison:
    """Compare two datasets: one scan of each side, and one shuffle if keys are given.

    ``max_columns`` leaves out the statistics of further columns; drift has only columns with both.
    """
    spark = left.sparkSession
    warnings: list[str] = []
    overlap = None
    if keys:  # a bad key is reported before anything is scanned
        overlap = key_overlap(left, right, keys)
        for key in dict.fromkeys(keys):
            note = _key_pair(field_of(left, key), field_of(right, key))[2]
            warnings += [note] if note else []
    statistics = []
    for label, df in (("left", left), ("right", right)):
        found = column_statistics(df, max_columns=max_columns, moments=False)
        total = len(df.schema.fields)
        if total > len(found.fields):
            warnings.append(f"{label}: profiled {len(found.fields)} of {total} columns, as asked.")
        statistics.append(found)
    l, r = statistics
    shared = sorted({f.name for f in l.fields} & {f.name for f in r.fields})
    rows = [(l.row_count, r.row_count, r.row_count - l.row_count, percent_change(l.row_count, r.row_count))]
    return Comparison(
        rows=spark.createDataFrame(rows, _ROWS),
        schema=schema_diff(left, right),
        drift=spark.createDataFrame(_drift_rows(l, r, shared), _DRIFT),
        key_overlap=overlap,
        warnings=tuple(warnings),
    )
