"""Dates out of date, timestamp and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.types import is_timestamp

# A text is a date only with year, month and day; Spark alone would also take '2024' and '2024-02'.
DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?\s*$"


def to_timestamp(value: Column, dtype: T.DataType) -> Column:
    """``TIMESTAMP_NTZ`` of a value, NULL where it is none. Numbers are never read as epochs."""
    if is_timestamp(dtype) or isinstance(dtype, T.DateType):
        return value.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return F.when(value.rlike(DATE_TEXT), F.trim(value).try_cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def month_start(value: Column) -> Column:
    """First instant of the month, still without a zone (``date_trunc`` returns a zoned value)."""
    return F.date_trunc("month", value).cast("timestamp_ntz")
