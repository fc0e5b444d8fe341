"""One text for equal numbers of any numeric type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.rendering import shortest_text
from dataproof.functions.types import is_fractional

#: Doubles from here on equal no integer or decimal of Spark.
BEYOND_DECIMALS = 1e38


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, outside the generated code of its surroundings."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_digits(number: Column) -> Column:
    """All digits of a whole double of less than 1e38: 64 bits and the two halves of the rest are exact integers."""
    size = F.abs(number)
    # Taking off and dividing by powers of two is exact; integers become decimals exactly, doubles do not.
    high = F.floor(size / F.lit(2.0**64))
    rest = size - high.cast("double") * F.lit(2.0**64)
    middle = F.floor(rest / F.lit(2.0**32))
    low = (rest - middle.cast("double") * F.lit(2.0**32)).cast("bigint")
    upper = high.cast("decimal(19,0)") * F.lit("18446744073709551616").cast("decimal(20,0)")
    lower = middle.cast("decimal(10,0)") * F.lit("4294967296").cast("decimal(10,0)") + low.cast("decimal(10,0)")
    digits = (upper.cast("decimal(38,0)") + lower.cast("decimal(21,0)")).cast("decimal(38,0)").cast("string")
    return F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), digits)


def normal_digits(text: Column) -> Column:
    """``-12e3`` for ``-12000``, ``-12000.0`` and ``-1.2E+4``: sign, digits without zeros at either end, and exponent."""

    def of_parts(parts: Column) -> Column:
        whole, fraction, exponent = (F.get(parts, F.lit(i)) for i in (1, 2, 3))

        def of_digits(digits: Column) -> Column:
            kept = F.regexp_replace(digits, "0+$", "")
            moved = F.length(digits) - F.length(kept) - F.length(fraction)
            shift = F.when(exponent == "", 0).otherwise(exponent.try_cast("int")) + moved
            return F.when(kept == "", F.lit("0")).otherwise(F.concat(F.get(parts, F.lit(0)), kept, F.lit("e"), shift.cast("string")))

        return _once(F.regexp_replace(F.concat(whole, fraction), "^0+", ""), of_digits)

    pattern = r"^([-]?)\+?(\d*)\.?(\d*)(?:[eE]\+?(-?\d+))?$"
    return _once(F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, 5)]), of_parts)


def numeric_key(value: Column, dtype: T.DataType) -> Column:
    """A text that is the same for equal numbers, whatever their types.

    Whole numbers have all their digits, so no two integers are taken for one because a double cannot tell them apart. A
    fraction of a double is the decimal with the fewest digits that denotes it (0.1 for the double that ``0.1`` is
    read as); a float counts as the double it is. Zero has no sign; NaN equals itself.
    """
    if not is_fractional(dtype):
        return F.when(value.isNotNull(), normal_digits(value.cast("string")))

    def of_double(number: Column) -> Column:
        # From 2**53 on all doubles are whole.
        size = F.abs(number)
        whole = ((size >= F.lit(2.0**53)) | (F.floor(number).cast("double") == number)) & (size < F.lit(BEYOND_DECIMALS))
        text = F.when(whole, whole_digits(number)).otherwise(shortest_text(number, number.cast("string")))
        infinite = F.abs(number) == F.lit(float("inf"))
        return F.when(F.isnan(number) | infinite, number.cast("string")).otherwise(normal_digits(text))

    return F.when(value.isNotNull(), _once(value.cast("double"), of_double))
