"""Correlations of many columns from one scan: mergeable matrices of co-moments.

A task turns its batches into matrices over all pairs of columns: how many rows have both values, the means of either
column over those rows, the sums of squared deviations and of products of deviations. Matrices of two batches are merged
by the parallel update of variances, so no order of batches loses digits to large values. No row is expanded by pairs: a
batch costs a few matrix products. The matrices leave a task as one row per column, are merged per group of tasks first and
per column then, and only the correlations reach the driver.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.functions.types import column
from dataproof.plans.compiled import small_methods
from dataproof.plans.two_level import FAN_IN

#: What a pair of columns has: rows with both values, rows of them with a value that is not finite, means of the first
#: and second column, sums of squared deviations, and the sum of products of deviations.
PARTS = ("rows", "odd", "mean_a", "mean_b", "square_a", "square_b", "product")
#: What is left of a sum of squares may be rounding if it is a smaller part than this.
LEAST_LEFT = 1e-6
#: A spread of so small a part of the mean is what rounding leaves of a constant.
LEAST_SPREAD = 1e-14

Matrices = dict[str, np.ndarray]


def batch_matrices(values: np.ndarray, present: np.ndarray) -> Matrices:
    """The co-moments of one batch (rows by columns); ``present`` tells values from NULL."""
    sound = present & np.isfinite(values)
    gaps = np.flatnonzero(~sound.all(axis=0))
    ones, gap_ones = sound.astype(np.float64), sound[:, gaps].astype(np.float64)

    def over(x: np.ndarray) -> np.ndarray:
        """The sums of the columns of ``x`` over the rows that have a value in each column: all rows where none is missing."""
        out = np.repeat(x.sum(axis=0)[:, None], x.shape[1], axis=1)
        out[:, gaps] = x.T @ gap_ones
        return out

    filled = np.where(sound, values, 0.0) if len(gaps) else values
    count = ones.sum(axis=0)
    middle = filled.sum(axis=0) / np.maximum(count, 1)
    # A column of one value only must not get a spread from rounding its mean.
    low, high = (values.min(axis=0), values.max(axis=0)) if not len(gaps) else (
        np.where(sound, values, np.inf).min(axis=0), np.where(sound, values, -np.inf).max(axis=0)
    )
    middle = np.where(low == high, low, middle)
    middle = np.where(np.isfinite(middle), middle, 0.0)
    apart = np.where(sound, values - middle, 0.0) if len(gaps) else values - middle
    rows = over(ones)
    known = np.maximum(rows, 1)
    sums, squares = over(apart), over(apart * apart)
    mean = sums / known
    bad = np.zeros_like(rows)
    if (present & ~sound).any():
        odd, there = (present & ~sound).astype(np.float64), present.astype(np.float64)
        bad = odd.T @ there + there.T @ odd - odd.T @ odd
    square = np.maximum(squares - sums * mean, 0.0)
    out = {
        "rows": rows,
        "odd": bad,
        "mean_a": mean + middle[:, None],
        "mean_b": mean.T + middle[None, :],
        "square_a": square,
        "square_b": square.T.copy(),
        "product": apart.T @ apart - sums * mean.T,
    }
    # Where nearly all of a sum of squares cancelled, rounding is what is left: those few pairs are added up again.
    for a, b in np.argwhere((square < LEAST_LEFT * squares) & (rows > 0)):
        both = sound[:, a] & sound[:, b]
        sides = [values[both, side] for side in (a, b)]
        means = [x[0] if x.min() == x.max() else x.mean() for x in sides]
        x, y = (side - mean for side, mean in zip(sides, means))
        for (i, j), first, second, means_ in (((a, b), x, y, means), ((b, a), y, x, means[::-1])):
            out["mean_a"][i, j], out["mean_b"][i, j] = means_
            out["square_a"][i, j], out["square_b"][i, j], out["product"][i, j] = first @ first, second @ second, x @ y
    return out


def merge_matrices(left: Matrices, right: Matrices) -> Matrices:
    """The co-moments of both inputs together; works on matrices and on rows of them."""
    rows = left["rows"] + right["rows"]
    part = right["rows"] / np.maximum(rows, 1)
    weight = left["rows"] * part
    a, b = right["mean_a"] - left["mean_a"], right["mean_b"] - left["mean_b"]
    # Where one side has no rows its means say nothing.
    a, b = np.where(weight > 0, a, 0.0), np.where(weight > 0, b, 0.0)
    none = left["rows"] == 0
    return {
        "rows": rows,
        "odd": left["odd"] + right["odd"],
        "mean_a": np.where(none, right["mean_a"], left["mean_a"] + a * part),
        "mean_b": np.where(none, right["mean_b"], left["mean_b"] + b * part),
        "square_a": left["square_a"] + right["square_a"] + a * a * weight,
        "square_b": left["square_b"] + right["square_b"] + b * b * weight,
        "product": left["product"] + right["product"] + a * b * weight,
    }


def correlations_of(found: Matrices) -> np.ndarray:
    """Pearson's coefficient; NaN where a column does not vary or a value is not finite."""
    rows = np.maximum(found["rows"], 1)
    spreads = []
    for side in ("a", "b"):
        spread = np.sqrt(found[f"square_{side}"] / rows)
        spreads.append(np.where(spread > LEAST_SPREAD * np.abs(found[f"mean_{side}"]), spread, 0.0))
    together = spreads[0] * spreads[1]
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = found["product"] / rows / together
    return np.where((found["odd"] == 0) & (together > 0) & np.isfinite(out), out, np.nan)


def _merge_all(found: Iterable[Matrices]) -> Matrices | None:
    """All co-moments together. Squares beyond what a double holds become infinite, and their correlation undefined."""
    total = None
    with np.errstate(over="ignore", invalid="ignore"):
        for one in found:
            total = one if total is None else merge_matrices(total, one)
    return total


def pair_correlations(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The correlation of each pair of the numeric columns ``names`` over the rows that have both; NaN where undefined."""
    size = len(names)
    cells = [f"{part} array<double>" for part in PARTS]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrices() -> Iterator[Matrices]:
            for batch in batches:
                if batch.num_rows:
                    values = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns]
                    present = [np.asarray(c.is_valid()) for c in batch.columns]
                    yield batch_matrices(np.stack(values).T, np.stack(present).T)

        total = _merge_all(matrices())
        if total is not None:
            lists = [pa.array(list(total[part]), pa.list_(pa.float64())) for part in PARTS]
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), *lists], ["a", *PARTS])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = _merge_all({part: rows[part].iloc[i] for part in PARTS} for i in range(len(rows)))
        return pd.DataFrame({"a": [rows["a"].iloc[0]], **{part: [total[part]] for part in PARTS}})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        total = _merge_all({part: rows[part].iloc[i] for part in PARTS} for i in range(len(rows)))
        return pd.DataFrame({"a": [rows["a"].iloc[0]], "r": [correlations_of(total)]})

    numbers = df.select(*[column(name).cast("double").alias(f"c{i}") for i, name in enumerate(names)])
    per_task = numbers.mapInArrow(of_task, ", ".join(["a int", *cells]))
    salted = per_task.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    merged = salted.groupBy("a", "salt").applyInPandas(lambda _, rows: merge(rows), ", ".join(["a int", *cells]))
    out = np.full((size, size), np.nan)
    # A row of numbers per column.
    with small_methods(df.sparkSession):
        found = merged.groupBy("a").applyInPandas(lambda _, rows: finish(rows), "a int, r array<double>").collect()
    for row in found:
        out[row["a"]] = [np.nan if r is None else r for r in row["r"]]
    return out


# The functions travel to the executors with the tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
