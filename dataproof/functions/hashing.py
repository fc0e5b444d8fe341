"""Hashes over complete rows. NULL and its position always count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.rendering import render, render_apart
from dataproof.functions.types import column, contains_map, is_fractional, is_nested


def hashable(value: Column, dtype: T.DataType) -> list[Column]:
    """The inputs that make ``xxhash64`` see every NULL of a value.

    ``xxhash64`` skips NULLs, also inside arrays and structs, and refuses maps.
    """
    if contains_map(dtype):
        # Variants list their keys in order, so equal maps render equally.
        text = F.to_json(value) if isinstance(dtype, T.VariantType) else F.to_json(
            F.parse_json(F.to_json(value, {"ignoreNullFields": "false"}))
        )
        return [value.isNull(), text]
    if isinstance(dtype, T.ArrayType) and not is_nested(dtype.elementType):
        return [value.isNull(), value, F.transform(value, lambda item: item.isNull())]
    if is_nested(dtype):
        return [value.isNull(), F.to_json(value, {"ignoreNullFields": "false"})]
    return [value.isNull(), value]


def value_hash(value: Column, dtype: T.DataType) -> Column:
    """64-bit hash of one value, NULL for NULL (the input of a distinct-count sketch)."""
    inputs = hashable(value, dtype)[1:]
    return F.when(value.isNotNull(), F.xxhash64(*inputs))


def row_hash(fields: Sequence[T.StructField]) -> list[Column]:
    """Two independently salted 64-bit hashes of a row: 128 bits that whole-stage codegen computes."""
    inputs = [part for field in fields for part in hashable(column(field.name), field.dataType)]
    return [F.xxhash64(F.lit(salt), *inputs) for salt in (17, 31)]


def portable_row_hash(fields: Sequence[T.StructField]) -> Column:
    """md5 over length-prefixed renderings: the same value in any engine, at the price of rendering."""
    parts = []
    for field in fields:
        draw = render_apart if is_fractional(field.dataType) else render
        text = draw(column(field.name), field.dataType)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.md5(F.concat(*parts) if parts else F.lit(""))


def order_hash(fields: Sequence[T.StructField], kind: str = "fast") -> list[Column]:
    """Sort keys that put rows in a fixed order, whatever the input order was."""
    if not fields:
        return [F.lit(0)]
    if kind == "fast":
        return row_hash(fields)
    if kind == "portable":
        return [portable_row_hash(fields)]
    raise ValueError(f"Unknown row hash: {kind}")
