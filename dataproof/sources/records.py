"""Records that span lines, cut out of large files in parallel.

A file is read in splits by Spark's text reader, in pieces that end at a character every record has at its end: line
breaks for CSV, closing braces for JSON. Whether a piece ends a record depends on what is open before it (a quoted value,
a string, how many brackets), which a split alone cannot know. So a first pass describes each split as a function: for
either state that it may begin in, the state at its end and what it adds to the depth. Functions of splits that follow
each other are composed by window sums over a table with one row per split; that gives the state at the start of every
split. The second pass cuts records. What lies before the first end and behind the last one in a split goes together
with the other parts of the same record, by the split that it begins in.

The splits of both passes must be the same: files are read by a session of their own whose split settings are fixed.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataproof.session import shared_dir

#: A split is at least so large, so that small files are still read by several tasks.
LEAST_SPLIT = 1 << 16

_BLOCKS = (
    "file long, start long, block long, size long, bytes long, pieces long, opens_array boolean, spans boolean, "
    "end0 int, delta0 long, low0 long, end1 int, delta1 long, low1 long"
)
_PARTS = "owner long, start long, first boolean, value string"


@dataclass(frozen=True)
class QuotedLines:
    """CSV: a piece is a line, and a record ends with each line that leaves no quoted value open."""

    field_separator: str
    end: str = "\n"
    glue: str = "\n"

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        """Whether a value is open after the piece, and the change of the depth (there is none)."""
        if '"' not in piece:
            return inside, 0
        place, separator = 0, self.field_separator
        while True:
            if not inside:
                # A value is quoted if it begins with the quote.
                if not piece.startswith('"', place):
                    place = piece.find(separator + '"', place)
                    if place < 0:
                        return 0, 0
                    place += len(separator)
                place += 1
            # Two quotes in a row are one of the value.
            close = piece.find('"', place)
            while close >= 0 and piece.startswith('"', close + 1):
                close = piece.find('"', close + 2)
            if close < 0:
                return 1, 0
            inside, place = 0, piece.find(separator, close)
            if place < 0:
                return 0, 0
            place += len(separator)

    def start_depth(self, piece: str) -> int:
        return 0

    def record(self, text: str) -> str:
        return text.removesuffix("\r")

    def leftover(self, text: str) -> str:
        return ""


@dataclass(frozen=True)
class ArrayItems:
    """JSON: a piece ends before a closing brace, and a record ends with the brace that closes an item of the top array
    (or a lone object)."""

    end: str = "}"
    glue: str = "}"

    def step(self, piece: str, inside: int) -> tuple[int, int]:
        """Whether a string is open after the piece, and the change of the depth, its closing brace included."""
        parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        delta = 0
        for part in parts[inside::2]:
            delta += part.count("{") + part.count("[") - part.count("]")
        after = inside ^ ((len(parts) - 1) & 1)
        return after, delta - (not after)

    def start_depth(self, piece: str) -> int:
        """The depth before the first piece of a file: items are at depth nought."""
        return -1 if piece.lstrip("﻿ \t\r\n").startswith("[") else 0

    def record(self, text: str) -> str:
        return _BEFORE_ITEM.sub("", text, count=1) + "}"

    def leftover(self, text: str) -> str:
        """What stands behind the last record, if it is more than the end of the array."""
        return "" if re.fullmatch(r"\s*\[?\s*\]?\s*", text.lstrip("﻿")) else text


_ESCAPED = re.compile(r"\\.", re.DOTALL)
_BEFORE_ITEM = re.compile("^﻿?[ \t\r\n]*[,\\[]?[ \t\r\n]*")
Cutter = QuotedLines | ArrayItems


def split_session(spark: SparkSession) -> SparkSession:
    """A session in which files are split alike however many cores there are at the time."""
    session = spark.newSession()
    parallel = spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.files.minPartitionNum", str(parallel))
    session.conf.set("spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    session.conf.set("spark.sql.files.openCostInBytes", str(LEAST_SPLIT))
    return session


def _pieces(session: SparkSession, path: str | list[str], cutter: Cutter) -> DataFrame:
    """``file, start, block, size, value`` of all pieces; pieces of a split are together and in order."""
    read = session.read.option("lineSep", cutter.end).text(path)
    file, start = F.xxhash64("_metadata.file_path"), F.col("_metadata.file_block_start")
    return read.select(
        file.alias("file"), start.alias("start"), F.xxhash64(file, start).alias("block"), F.col("_metadata.file_size").alias("size"), "value"
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool]]:
    """Runs of pieces of one split with its ``file, start, block, size``, and whether the run is the first of the split."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            name = tuple(batch.column(i)[low].as_py() for i in range(4))
            yield name, batch.column(4).slice(low, high - low).to_pylist(), name != last
            last = name


def _describe(cutter: Cutter):
    """Splits as functions of the state at their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _BLOCKS.split(", "))])
        row = None
        for (file, start, block, size), pieces, new in _by_block(batches):
            if new:
                if row is not None:
                    yield pa.RecordBatch.from_pylist([row], schema)
                row = {"file": file, "start": start, "block": block, "size": size, "bytes": 0, "pieces": 0, "opens_array": False, "spans": False}
                row |= {"end0": 0, "delta0": 0, "low0": _NONE, "end1": 1, "delta1": 0, "low1": _NONE}
                if start == 0:
                    row["opens_array"] = cutter.start_depth(pieces[0]) < 0
            for piece in pieces:
                row["bytes"] += len(piece.encode())
                row["pieces"] += 1
                for s in "01":
                    row["end" + s], delta = cutter.step(piece, row["end" + s])
                    row["delta" + s] += delta
                    if not row["end" + s]:
                        row["low" + s] = min(row["low" + s], row["delta" + s])
                row["spans"] |= row["end0"] == 1
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema)

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_NONE = 1 << 40


def _with_states(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the state (``inside``, ``depth``) at their start, and for those that begin within a record the
    split in which it begins (``owner``)."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("end0") == F.col("end1")
    turns = F.when(~fixed & (F.col("end0") == 1), 1).otherwise(0)
    rows = blocks.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    # A split whose end does not depend on its start begins the count of turns anew.
    reset = F.last(F.when(fixed, F.struct(F.col("end0").alias("end"), F.col("turned").alias("turned"))), ignorenulls=True).over(before)
    rows = rows.withColumn("reset", reset)
    since = F.col("turned") - F.coalesce("reset.turned", F.lit(0))
    rows = rows.withColumn("inside", ((F.coalesce("reset.end", F.lit(0)) + since) % 2).cast("int"))

    def by_state(name: str) -> Column:
        return F.when(F.col("inside") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    # Depths count from the items: one bracket of an array lies below.
    array = F.max(F.when((F.col("start") == 0) & F.col("opens_array"), 1).otherwise(0)).over(Window.partitionBy("file"))
    rows = rows.withColumn("array", array)
    rows = rows.withColumn("depth", F.coalesce(F.sum(by_state("delta")).over(before), F.lit(0)) - F.col("array"))
    rows = rows.withColumn("within", (F.col("inside") == 1) | (F.col("depth") > 0))
    opens = ~F.col("within") | (F.col("depth") + by_state("low") <= 0)
    owner = F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)
    return rows.withColumns(
        {
            "owner": F.when(F.col("within"), owner),
            "end": by_state("end"),
            "end_depth": F.col("depth") + by_state("delta"),
        }
    )


def _broken_files(states: DataFrame) -> DataFrame:
    """The files whose last split ends within a record. A piece that the file ends with has no closing brace."""
    last = states.groupBy("file").agg(
        F.max_by(F.struct("end", "end_depth"), "start").alias("last"),
        F.sum(F.col("bytes") + F.col("pieces")).alias("read"),
        F.max("size").alias("size"),
        F.max("array").alias("array"),
    )
    # Of a compressed file the size does not tell whether its last piece was closed.
    added = F.when(F.col("read") == F.col("size") + 1, F.array(F.lit(1))).when(F.col("read") == F.col("size"), F.array(F.lit(0)))
    depths = F.transform(F.coalesce(added, F.array(F.lit(0), F.lit(1))), lambda x: x + F.col("last.end_depth"))
    return last.where((F.col("last.end") == 1) | ~F.array_contains(depths, -F.col("array").cast("long")))


def _cut(cutter: Cutter, known):
    """Records of splits; parts of records that span splits with the split that they begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _PARTS.split(", "))])
        blocks, insides, depths, owners = known.value
        out: list[tuple] = []
        held: list[str] = []
        state = None

        def close() -> None:
            """The end of a split."""
            if not held:
                return
            if state["inside"] or state["depth"] > 0:
                owner = state["block"] if state["owner"] is None else state["owner"]
                out.append((owner, state["start"], state["first"], cutter.glue.join(held)))
            elif text := cutter.leftover(cutter.glue.join(held)):
                out.append((None, state["start"], False, text))
            held.clear()

        for (_, start, block, _), pieces, new in _by_block(batches):
            if new:
                if state is not None:
                    close()
                place = int(np.searchsorted(blocks, block))
                state = {"block": block, "start": start, "inside": 0, "depth": 0, "owner": None, "first": start == 0}
                if place < len(blocks) and blocks[place] == block:
                    state |= {"inside": int(insides[place]), "depth": int(depths[place]), "owner": int(owners[place])}
                elif start == 0:
                    state["depth"] = cutter.start_depth(pieces[0])
                    pieces[0] = pieces[0].removeprefix("﻿")
            for piece in pieces:
                held.append(piece)
                state["inside"], delta = cutter.step(piece, state["inside"])
                state["depth"] += delta
                if state["inside"] or state["depth"] != 0:
                    continue
                text = cutter.glue.join(held)
                held.clear()
                if state["owner"] is not None:
                    out.append((state["owner"], start, state["first"], text))
                    state["owner"] = None
                elif not text.strip():
                    continue
                else:
                    out.append((None, start, state["first"], cutter.record(text)))
                state["first"] = False
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema.names)
                out.clear()
        if state is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema.names)

    return run


@dataclass(frozen=True)
class Records:
    """``rows`` (``value``, and ``first`` for the first record of each file) and the number of tasks that read the files."""

    rows: DataFrame
    splits: int


def cut_records(spark: SparkSession, path: str | list[str], cutter: Cutter) -> Records | None:
    """The records of all files as texts, or None if every line of a CSV file is a record.

    The driver holds 24 bytes for each split that begins within a record. Records that span splits are put together
    once and written to the shared folder; they are at most as many as there are splits.
    """
    session = split_session(spark)
    pieces = _pieces(session, path, cutter)
    folder = shared_dir(spark, "splits")
    pieces.mapInArrow(_describe(cutter), _BLOCKS).write.parquet(folder)
    states = _with_states(spark.read.parquet(folder))
    if isinstance(cutter, QuotedLines):
        # All files begin outside of values, so these are all the lines that leave one open.
        if not states.where("spans").limit(1).count():
            return None
        broken = states.groupBy("file").agg(F.max_by("end", "start").alias("end")).where("end = 1")
    else:
        broken = _broken_files(states)
    if broken.limit(1).count():
        raise ValueError("a file ends within a record")
    within = states.where("within").select("block", "inside", "depth", "owner").orderBy("block").toArrow()
    columns = [within.column(i).to_numpy() for i in range(4)]
    known = spark.sparkContext.broadcast(tuple(np.array(x) for x in columns))
    parts = pieces.mapInArrow(_cut(cutter, known), _PARTS)
    whole = parts.where("owner IS NULL").select("value", "first")
    if len(columns[0]):
        joined = parts.where("owner IS NOT NULL").groupBy("owner").agg(
            F.array_sort(F.collect_list(F.struct("start", "value"))).alias("parts"), F.bool_or("first").alias("first")
        )
        text = F.array_join(F.transform("parts", lambda x: x["value"]), cutter.glue)
        joined = joined.select(_finished(text, cutter).alias("value"), "first")
        folder = shared_dir(spark, "spanning")
        joined.write.parquet(folder)
        whole = whole.unionAll(spark.read.schema(joined.schema).parquet(folder))
    return Records(whole, states.count())


def _finished(text: Column, cutter: Cutter) -> Column:
    if isinstance(cutter, QuotedLines):
        return F.regexp_replace(text, "\r$", "")
    return F.concat(F.regexp_replace(text, "^﻿?[ \t\r\n]*[,\\[]?[ \t\r\n]*", ""), F.lit("}"))


# The functions travel to the executors with the tasks; nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
