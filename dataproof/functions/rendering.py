"""Text rendering of values, independent of partitioning and of Java's exponent switch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.types import is_fractional, is_nested


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def _rounded(value: Column, digits: int) -> tuple[Column, Column]:
    """Text with the given number of significant digits, and whether it still is the same number."""
    text = F.format_string(f"%.{digits - 1}e", value.cast("double"))
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)e", 1), "0+$", "")
    mantissa = F.when(F.endswith(mantissa, F.lit(".")), F.concat(mantissa, F.lit("0"))).otherwise(mantissa)
    exponent = F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int").cast("string")
    return F.concat(mantissa, F.lit("E"), exponent), text.try_cast("double") == value


def shortest_text(value: Column, text: Column) -> Column:
    """Digits of a number, the fewest that give it back; ``text`` is the number cast to a string.

    Java versions before 19 sometimes write up to three digits that are not needed.
    """
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"^-?0*\.?0*|\.", ""))
    result = F.when((F.length(text) < 17) | (digits < 17), text)
    for count in (15, 16, 17):
        rounded, same = _rounded(value, count)
        result = result.when(same, rounded)
    return result.otherwise(text)


def plain_text(value: Column, text: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16, otherwise ``1.5e+16``; whole numbers keep ``.0``.

    ``text`` is the shortest text of the number.
    """
    size = F.abs(value.cast("double"))
    # 16 whole digits and 21 decimals hold every 17-digit double of the plain range exactly.
    decimal = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(decimal, r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, "E-?(\\d+)$", 1)
    sign = F.when(text.contains("E-"), F.lit("e-")).otherwise(F.lit("e+"))
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == F.lit(float("inf")), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~text.contains("E"), text)
        .when((size >= F.lit(1e-4)) & (size < F.lit(1e16)), plain)
        .otherwise(F.concat(mantissa, sign, F.lpad(exponent, F.greatest(F.length(exponent), F.lit(2)), "0")))
    )


def render_apart(value: Column, dtype: T.DataType) -> Column:
    """The same text as :func:`render`, outside the generated code of its surroundings.

    Rendering a fraction is a large expression; several of them exceed what the JVM compiles as one method.
    """
    return F.get(F.transform(F.array(value), lambda item: render(item, dtype)), F.lit(0))


def render(value: Column, dtype: T.DataType) -> Column:
    """Text of a value; NULL stays NULL."""
    if isinstance(dtype, T.StringType):
        return value
    if is_fractional(dtype):
        return F.when(value.isNotNull(), plain_text(value, shortest_text(value, value.cast("string"))))
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    if is_nested(dtype):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast("string")
