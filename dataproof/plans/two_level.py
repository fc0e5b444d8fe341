"""Per-column aggregates over a whole table, in a plan whose size does not grow with it.

Every analysis of "all columns" first turns a row into one narrow row per column and then
groups by the column's position. The alternative, one aggregate with a few expressions per
column, compiles into a single method that the JVM no longer optimises beyond some dozen
columns; on 48 columns it is more than ten times slower.

Sketches are merged in two levels. A plain group-by ends in one task per column that reads a
sketch of tens of kilobytes from every input task, terabytes on an input of hundreds of
thousands of tasks. The first level therefore merges groups of input tasks, and only a
bounded number of sketches per column reaches the second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 256


def melt(df: DataFrame, cells: Sequence[Sequence[Column]]) -> DataFrame:
    """One row per input row and cell: ``position`` and the cell's named values.

    All cells must name the same values with the same types.
    """
    structs = [F.struct(F.lit(position).alias("position"), *cell) for position, cell in enumerate(cells)]
    return df.select(F.inline(F.array(*structs)))


def aggregate_two_level(
    melted: DataFrame, partial: Sequence[Column], merge: Sequence[Column], by: Sequence[str] = ("position",)
) -> DataFrame:
    """``merge`` aggregates over at most ``FAN_IN`` rows of ``partial`` aggregates per group."""
    salt = F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("_salt")
    return melted.groupBy(salt, *by).agg(*partial).groupBy(*by).agg(*merge)
