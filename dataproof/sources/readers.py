"""CSV, JSON, NDJSON and Parquet into DataFrames whose schema is inferred once and then fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.functions.dates import DATE_TEXT
from dataproof.functions.types import column
from dataproof.sources.records import ArrayItems, QuotedLines, cut_records

FORMATS = ("csv", "json", "ndjson", "parquet")

# The separators that are tried on the header line, in this order on a tie.
SEPARATORS = (",", ";", "\t", "|")

_PLAIN_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def read_dataset(
    spark: SparkSession,
    path: str | list[str],
    format: str,
    *,
    separator: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A lazy DataFrame over files of one format.

    CSV has a header; its separator is taken from the header line. ``multi_line`` tells
    whether quoted CSV values may contain line breaks. Left open, one pass over the lines
    decides. Files with such values are cut into records in parallel splits too, and so are
    JSON arrays (see :mod:`dataproof.sources.records`); their records are parsed as texts.
    """
    if format == "csv":
        return _read_csv(spark, path, separator, multi_line)
    if format == "json":
        return _read_json(spark, path, multi_line=True)
    if format == "ndjson":
        return _read_json(spark, path, multi_line=False)
    if format == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    raise ValueError(f"Unknown format: {format}")


def _inference_session(spark: SparkSession) -> SparkSession:
    """Where schemas are inferred: timestamps without a zone, as in Parquet files without one."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    return session


def _widened(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.IntegerType) else f.dataType) for f in schema]
    )


def sniff_separator(header: str) -> str:
    outside_quotes = "".join(header.split('"')[::2])
    return max(SEPARATORS, key=lambda s: (outside_quotes.count(s), -SEPARATORS.index(s)))


def _inferred_from(reader, texts: DataFrame, format: str) -> T.StructType:
    """The schema of records that are rows of text."""
    encoder = texts.sparkSession.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    return T._parse_datatype_json_string(getattr(reader._jreader, format)(getattr(texts._jdf, "as")(encoder)).schema().json())


def _parsed(texts: DataFrame, parse, schema: T.StructType, options: dict) -> DataFrame:
    """The columns of records that are rows of text; only the selected ones are parsed."""
    # DDL cannot express every name, so the record is parsed by places and renamed.
    named = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    rows = texts.select(parse(F.col("value"), named.simpleString(), {k: str(v).lower() if v is True or v is False else v for k, v in options.items()}).alias("r"))
    return rows.select([F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema)])


def _read_csv(spark: SparkSession, path: str | list[str], separator: str | None, multi_line: bool | None) -> DataFrame:
    lines = spark.read.text(path)
    if separator is None:
        first = lines.where(F.trim("value") != "").first()
        if first is None:
            raise ValueError("csv: only blank lines")
        separator = sniff_separator(first["value"].removeprefix("﻿"))
    options = {"header": True, "sep": separator, "escape": '"', "mode": "FAILFAST"}
    records = None if multi_line is False else cut_records(spark, path, QuotedLines(separator))
    if records is not None:
        return _read_csv_records(spark, records.rows, options)
    inferred = _inference_session(spark).read.options(**options).option("inferSchema", True).csv(path).schema
    # Reading with the widened schema, instead of casting afterwards, keeps filters and
    # column selection in the scan.
    return spark.read.options(**options).schema(_widened(inferred)).csv(path)


def _read_csv_records(spark: SparkSession, records: DataFrame, options: dict) -> DataFrame:
    session = _inference_session(spark)
    header = records.where("first").select("value").first()["value"]
    heading = _inferred_from(session.read.options(**options), session.createDataFrame([(header,)], "value string"), "csv")
    options = options | {"header": False}
    texts = records.where("NOT first").select("value")
    inferred = _widened(_inferred_from(session.read.options(**options).option("inferSchema", True), texts, "csv"))
    if len(inferred) == 0:
        return spark.createDataFrame([], heading)
    types = [f.dataType for f in inferred] + [T.StringType()] * (len(heading) - len(inferred))
    schema = T.StructType([T.StructField(h.name, kind) for h, kind in zip(heading, types)])
    return _parsed(texts, F.from_csv, schema, options)


def _read_json(spark: SparkSession, path: str | list[str], *, multi_line: bool) -> DataFrame:
    options = {"mode": "FAILFAST"}
    session = _inference_session(spark)
    if not multi_line:
        inferred = session.read.options(**options).json(path).schema
        typed = _with_dates(spark.read.options(**options).schema(inferred).json(path))
        schema = _in_order(typed, _keys_of_first(spark.read.text(path).where(F.trim("value") != "")))
        return spark.read.options(**options).schema(schema).json(path)
    records = cut_records(spark, path, ArrayItems()).rows
    texts = records.select("value")
    inferred = _inferred_from(session.read.options(**options), texts, "json")
    if len(inferred) == 0:
        return spark.createDataFrame([], inferred)
    typed = _with_dates(_parsed_json(texts, inferred, options))
    return _parsed_json(texts, _in_order(typed, _keys_of_first(records.where("first").select("value"))), options)


def _parsed_json(texts: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """The columns of JSON objects that are rows of text."""
    return texts.select(F.from_json("value", schema, options).alias("r")).select(
        [F.col("r")[f.name].alias(f.name) for f in schema]
    )


def _in_order(schema: T.StructType, order: list[str]) -> T.StructType:
    fields = {f.name: f for f in schema.fields}
    names = [name for name in order if name in fields] + [f.name for f in schema.fields if f.name not in order]
    return T.StructType([fields[name] for name in names])


def _with_dates(df: DataFrame) -> T.StructType:
    """The schema with text columns that hold only dates, or only timestamps, typed as such."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.schema
    checks = []
    for i, name in enumerate(texts):
        value = column(name)
        is_date = value.rlike(_PLAIN_DATE) & value.try_cast("date").isNotNull()
        is_time = value.rlike(DATE_TEXT) & value.try_cast("timestamp_ntz").isNotNull()
        for label, holds in (("date", is_date), ("time", is_time)):
            checks.append(F.bool_and(F.when(value.isNotNull(), holds)).alias(f"{label}{i}"))
    row = df.agg(*checks).first()
    types = {}
    for i, name in enumerate(texts):
        if row[f"date{i}"]:
            types[name] = T.DateType()
        elif row[f"time{i}"]:
            types[name] = T.TimestampNTZType()
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in df.schema.fields])


def _keys_of_first(texts: DataFrame) -> list[str]:
    """Keys of the first record in their order; Spark's inference sorts them by name."""
    row = texts.select(F.json_object_keys("value").alias("keys")).first()
    return list(row["keys"] or []) if row else []
