"""Column classes, decided on ``DataType`` instances rather than on type names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_TIMESTAMP = (T.TimestampType, T.TimestampNTZType)
_INTERVAL = (T.DayTimeIntervalType, T.YearMonthIntervalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FRACTIONAL)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*_INTEGRAL, *_FRACTIONAL, T.DecimalType))


def is_timestamp(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TIMESTAMP)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, *_TIMESTAMP, *_INTERVAL))


def is_chart_temporal(dtype: T.DataType) -> bool:
    """Intervals have extremes in a profile but no place on a time axis."""
    return isinstance(dtype, (T.DateType, *_TIMESTAMP))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def is_groupable(dtype: T.DataType) -> bool:
    """Binary and nested columns get null and distinct counts only, no frequent values."""
    return not isinstance(dtype, (T.BinaryType, T.NullType, *_NESTED))


def contains_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return True
    if isinstance(dtype, T.ArrayType):
        return contains_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(contains_map(field.dataType) for field in dtype.fields)
    return False


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """A reference to a top-level column whatever characters its name has."""
    return F.col(quoted(name))


def field_of(df: DataFrame, name: str, role: str = "column") -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"Unknown {role}: {name}")
