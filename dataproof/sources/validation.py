"""Checks of raw payloads before anything is inferred from them."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataproof.functions.canonical import is_strict_json
from dataproof.sources.manifest import BLOCK_BYTES, dataset_manifest, listed_files, open_file
from dataproof.sources.readers import FORMATS

_NUL = "\x00"
_PARQUET_MAGIC = b"PAR1"


def validate_files(spark: SparkSession, path: str | list[str], format: str) -> DataFrame:
    """``path, name, format, bytes, digest, valid, error`` per file.

    Line formats are checked line by line in splits. JSON files are read block by block in one task each, of
    Parquet files only both ends; any size takes the same memory.
    """
    if format not in FORMATS:
        raise ValueError(f"Unknown format: {format}")
    manifest = dataset_manifest(spark, path, format).withColumnRenamed("source_url", "path")
    if format in ("json", "parquet"):
        errors = _whole_file_errors(spark, path, format)
    else:
        errors = _line_errors(spark.read.text(path), format)
    # Empty files have no lines and so no row on the right.
    error = F.when(F.col("bytes") == 0, F.lit("no bytes")).otherwise(
        F.when(F.col("checked").isNull(), F.lit(_nothing(format))).otherwise(F.col("error"))
    )
    return (
        manifest.join(errors.withColumn("checked", F.lit(True)), "path", "left")
        .withColumn("error", error)
        .select("path", "name", "format", "bytes", "digest", F.col("error").isNull().alias("valid"), "error")
    )


def _nothing(format: str) -> str:
    return f"{format}: only blank lines"


def _whole_file_errors(spark: SparkSession, path: str | list[str], format: str) -> DataFrame:
    check = _parquet_error if format == "parquet" else _json_error

    def errors(batches):
        for batch in batches:
            batch["error"] = [check(name, size) for name, size in zip(batch["path"], batch["length"])]
            yield batch[["path", "error"]]

    return listed_files(spark, path).mapInPandas(errors, "path string, error string")


def _parquet_error(path: str, size: int) -> str | None:
    """Only the first and the last four bytes are read."""
    with open_file(path) as file:
        head = file.read(4)
        file.seek(max(0, size - 4))
        tail = file.read(4)
    return None if size >= 8 and head == tail == _PARQUET_MAGIC else "parquet: first or last bytes are not PAR1"


# The grammar of JSON.
_IN_STRING = r"""(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"""
_JSON_TOKEN = re.compile(
    rf"""[ \t\r\n]*+(?:([{{}}\[\],:])|("{_IN_STRING}")"""
    r"""|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null))"""
)
_STRING_PART = re.compile(_IN_STRING)
_IN_NUMBER = re.compile(r"[0-9.eE+-]*")
#: What a number or a word may look like before its end is read.
_BEGUN = re.compile(r"-?[0-9]*+(?:\.[0-9]*+)?(?:[eE][+-]?[0-9]*+)?|t(r(ue?)?)?|f(a(l(se?)?)?)?|n(u(ll?)?)?")
#: Longer keys are told apart by a digest.
LONG_KEY = 1024


def _json_error(path: str, size: int) -> str | None:
    """Reads the file in blocks and keeps only the open brackets and the keys of open objects."""
    decoder, wrong = codecs.getincrementaldecoder("utf-8-sig")(), "json: not one JSON value"
    checker = JsonChecker()
    rest, step = "", BLOCK_BYTES
    with open_file(path) as file:
        while True:
            block = file.read(step)
            try:
                text = decoder.decode(block, final=not block)
            except UnicodeDecodeError:
                return wrong
            if "\0" in text:
                return "text: zero byte"
            rest = checker.feed(rest + text, final=not block)
            if rest is None:
                return wrong
            # A number longer than a block is read in steps that grow with it; strings are not held.
            step = max(BLOCK_BYTES, len(rest))
            if not block:
                return None if checker.complete and not rest.strip(" \t\r\n") else wrong


class _Key:
    """What a key is told apart by, put together from parts: itself, or a digest if it is long."""

    def __init__(self):
        self.text, self.length, self.digest = "", 0, hashlib.sha256()

    def add(self, part: str) -> None:
        # Halves of a character may be in two parts.
        units = json.loads(f'"{part}"').encode("utf-16-le", "surrogatepass")
        self.digest.update(units)
        self.length += len(units)
        if self.length <= 2 * LONG_KEY:
            self.text += units.hex()

    def value(self) -> str:
        return self.text if self.length <= 2 * LONG_KEY else f"digest {self.length} {self.digest.hexdigest()}"


class JsonChecker:
    """Checks that a text is one JSON value without repeated keys, piece by piece."""

    def __init__(self):
        self.open: list[set[str] | None] = []  # the keys of open objects, None for arrays
        self.state = "value"
        self.key: _Key | None = None  # the string that the last piece ended in
        self.inside = False

    @property
    def complete(self) -> bool:
        return not self.open and self.state == "end" and not self.inside

    def feed(self, text: str, final: bool) -> str | None:
        """What is left of ``text`` for the next piece; None if it is wrong."""
        at = 0
        if self.inside:
            at = self._string(text, 0)
            if at < 0 or self.inside:
                return None if at < 0 or final else text[at:]
        while match := _JSON_TOKEN.match(text, at):
            # The end of a number or a word is only known from what follows it.
            if match[3] and not final and _IN_NUMBER.match(text, match.end()).end() == len(text):
                break
            if not self._take(match[1], match[2]):
                return None
            at = match.end()
        left = text[at:].lstrip(" \t\r\n")
        if not left:
            return ""
        if final:
            return None
        if left[0] == '"':
            if self.state not in ("value", "first value", "key", "first key"):
                return None
            self.inside, self.key = True, _Key() if self.state in ("key", "first key") else None
            at = self._string(left, 1)
            return None if at < 0 else left[at:]
        return left if _BEGUN.fullmatch(left) else None

    def _string(self, text: str, at: int) -> int:
        """Goes on in a string; the place behind what is used up, or -1 if it is wrong."""
        end = _STRING_PART.match(text, at).end()
        if self.key is not None:
            self.key.add(text[at:end])
        if end == len(text):
            return end
        if text[end] == '"':
            self.inside = False
            return end + 1 if self._take(None, '""', self.key.value() if self.key is not None else None) else -1
        # An escape may go on in the next piece.
        return end if text[end] == "\\" and re.fullmatch(r"\\(u[0-9a-fA-F]{0,3})?", text[end:]) else -1

    def _take(self, mark: str | None, string: str | None, key: str | None = None) -> bool:
        state = self.state
        if mark in ("{", "["):
            if state not in ("value", "first value"):
                return False
            self.open.append(set() if mark == "{" else None)
            self.state = "first key" if mark == "{" else "first value"
        elif mark in ("}", "]"):
            if not self.open or state not in (("first key", "end") if mark == "}" else ("first value", "end")):
                return False
            if (self.open.pop() is None) == (mark == "}"):
                return False
            self.state = "end"
        elif mark == ",":
            if state != "end" or not self.open:
                return False
            self.state = "value" if self.open[-1] is None else "key"
        elif mark == ":":
            if state != "colon":
                return False
            self.state = "value"
        elif state in ("key", "first key"):
            if string is None:
                return False
            if key is None:
                whole = _Key()
                whole.add(string[1:-1])
                key = whole.value()
            if key in self.open[-1]:
                return False
            self.open[-1].add(key)
            self.state = "colon"
        elif state in ("value", "first value"):
            self.state = "end"
        else:
            return False
        return True


def line_status(text: Column, format: str) -> Column:
    """What is wrong with one non-blank line, NULL if nothing."""
    nul = F.when(text.contains(_NUL), F.lit("nul"))
    if format == "ndjson":
        return F.coalesce(nul, F.when(~is_strict_json(text), F.lit("json")))
    return nul


def _line_errors(lines: DataFrame, format: str) -> DataFrame:
    """First error per file; record numbers count non-blank lines from 1.

    A file is read in splits that do not know their line numbers. The rows of a split carry
    consecutive ids, so a split reports its first id, its number of lines and its first bad
    id; a running total over the few splits of each file turns that into a number.
    """
    split = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value"),
    ).where(F.col("value").rlike(r"\S"))
    rows = split.select("path", "start", F.monotonically_increasing_id().alias("id"), line_status(F.col("value"), format).alias("status"))
    per_split = rows.groupBy("path", "start").agg(
        F.min("id").alias("first"),
        F.count(F.lit(1)).alias("lines"),
        F.min(F.when(F.col("status") == "json", F.col("id"))).alias("bad_json"),
        F.max(F.col("status") == "nul").alias("has_nul"),
    )
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_split.withColumn("offset", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
    per_file = numbered.groupBy("path").agg(
        F.min(F.col("offset") + F.col("bad_json") - F.col("first") + 1).alias("bad_line"),
        F.max("has_nul").alias("has_nul"),
    )
    error = F.when(F.col("has_nul"), F.lit("text: zero byte")).when(
        F.col("bad_line").isNotNull(),
        F.concat(F.lit("ndjson: record "), F.col("bad_line").cast("string"), F.lit(" is not one JSON value")),
    )
    return per_file.select("path", error.alias("error"))


# The functions that run on the executors travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
