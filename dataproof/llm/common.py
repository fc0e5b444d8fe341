"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the shared folder that the session names in ``spark.checkpoint.dir``.

    Where the setting is missing, the warehouse is used, which all executors share as well. All folders
    of an application lie in one, which its owner can drop when the application has ended.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str, pack: bool = False, hashes: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor
    depend on executors that held parts of it. ``pack`` takes more time to write less, for tables with texts.
    ``hashes`` is for tables of hashes and measures, which a dictionary of their values would not make smaller.

    Shuffle files of the write go when it has ended, so disks hold those of one step, not of all steps so far."""
    spark, folder = df.sparkSession, scratch_dir(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer = df.write.option("parquet.enable.dictionary", "false") if hashes else df.write
        writer.parquet(folder, compression="zstd" if pack else "snappy")
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`settle` wrote, when all that is read of it has been written elsewhere."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
        if folder.getParent().getName() != spark.sparkContext.applicationId:
            raise ValueError(f"{file} is not of a settled table")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast that executors can read with :func:`shared` even if this package is not installed there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast: Broadcast):
    return cloudpickle.loads(broadcast.value)


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(df[column], F.lit(""))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by their places, so that no added column can clash with them, and those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


#: Tables of at most so many bytes are broadcast by :func:`join_small`; beyond, keys are dealt over so many tasks.
BROADCAST_BYTES, SALT = 32 << 20, 32


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], salt: Column) -> DataFrame:
    """A left join with a written table of few bytes a key: by broadcast up to a measured size, else by a shuffle in
    which each key of ``rows`` is dealt over ``SALT`` tasks by ``salt``."""
    bytes_of = sum((F.length(F.to_json(F.struct(F.col(name)))) for name in small.columns), F.lit(0))
    if (small.agg(F.sum(bytes_of)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), list(keys), "left")
    copies = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(salt), F.lit(SALT)).cast("int"))
    return salted.join(copies, [*keys, "salt_"], "left").drop("salt_")


def crc_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_batches(
    batches: Iterable[pa.RecordBatch], text: str = "text", max_bytes: int = 8 << 20, max_rows: int = 4096
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with at most ``max_bytes`` of text (one row at least), and their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_rows, batch.num_rows)
            part = batch.slice(start, stop - start)
            yield part, [x or "" for x in column.slice(start, stop - start).to_pylist()]
            start = stop


class Words64(dict):
    """64-bit numbers of words, kept for words seen before; emptied when it grows too large."""

    limit = 1 << 18

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        self[word] = number = xxhash.xxh3_64_intdigest(word)
        return number


def hashes64(words: pa.Array) -> np.ndarray:
    """The 64-bit numbers of :class:`Words64` for an array of words."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words))


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly (the splitmix64 finaliser)."""
    z = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z


class Hashed:
    """An open-addressing table from 64-bit keys to 32-bit values, looked up for whole arrays.

    Keys are distinct. At most half of the places are taken; absent keys give ``missing``.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int = -1):
        keys = np.ascontiguousarray(keys, dtype=np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.missing = missing
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.full(1 << self.bits, missing, dtype=np.int32)
        self.used = np.zeros(1 << self.bits, dtype=bool)
        self.probes = 1
        place, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = ~self.used[place[left]]
            # Of several keys that want one free place, the first takes it.
            _, first = np.unique(place[left][free], return_index=True)
            won = left[free][first]
            self.keys[place[won]] = keys[won]
            self.values[place[won]] = values[won]
            self.used[place[won]] = True
            left = np.setdiff1d(left, won, assume_unique=True)
            place[left] = (place[left] + 1) & self.mask
            self.probes += bool(len(left))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        used = self.used[place]
        hit = used & (self.keys[place] == keys)
        found = np.where(hit, self.values[place], np.int32(self.missing))
        left = np.flatnonzero(used & ~hit)
        place = place[left]
        while len(left):
            place = (place + 1) & self.mask
            used = self.used[place]
            hit = used & (self.keys[place] == keys[left])
            found[left[hit]] = self.values[place[hit]]
            on = used & ~hit
            left, place = left[on], place[on]
        return found
