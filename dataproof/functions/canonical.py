"""Canonical JSON text and its SHA-256.

Keys are sorted at every level, NULL members stay, numbers lose redundant zeros, binary is
base64 and timestamps are ISO-8601 in UTC with microseconds. The text is produced by the
VARIANT writer, inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.types import is_fractional

CANONICALIZATION = "dataproof-sorted-json-v1"

_JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
}


def _non_finite(value: Column, dtype: T.DataType) -> Column | None:
    """Whether any number inside the value is NaN or infinite; None when none can be."""
    if is_fractional(dtype):
        return F.coalesce(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(False))
    if isinstance(dtype, T.ArrayType):
        if _non_finite(F.lit(None), dtype.elementType) is None:
            return None
        return F.coalesce(F.exists(value, lambda item: _non_finite(item, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.MapType):
        return _non_finite(F.map_values(value), T.ArrayType(dtype.valueType))
    if isinstance(dtype, T.StructType):
        checks = [_non_finite(value.getField(field.name), field.dataType) for field in dtype.fields]
        checks = [check for check in checks if check is not None]
        if not checks:
            return None
        found = checks[0]
        for check in checks[1:]:
            found = found | check
        return found
    return None


def canonical_text(json_text: Column) -> Column:
    """Canonical form of JSON text; NULL where the text does not parse."""
    return F.to_json(F.try_parse_json(json_text))


def canonical_json(value: Column, dtype: T.DataType) -> Column:
    """Canonical JSON of a struct, map, array or variant column.

    NULL where the value is NULL or has a number that JSON cannot hold (NaN and the infinities).
    """
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    text = F.to_json(F.parse_json(F.to_json(value, _JSON_OPTIONS)))
    bad = _non_finite(value, dtype)
    if bad is None:
        return text
    return F.when(~bad, text)


def has_non_finite(value: Column, dtype: T.DataType) -> Column:
    """Whether a value has a number that JSON cannot hold, which is why it has no canonical form."""
    bad = _non_finite(value, dtype)
    return F.lit(False) if bad is None else bad


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def strict_variant(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, NULL for any other text.

    The parser stops after the first value and ignores what follows, so the text is parsed
    as the only element of an array and as the only member of an object: no text with a
    trailing remainder passes both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_object.isNotNull(), F.variant_get(in_array, "$[0]", "variant"))


def is_strict_json(text: Column) -> Column:
    return strict_variant(text).isNotNull()
