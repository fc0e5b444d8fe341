"""One evidence record per file: name, size and SHA-256 of the bytes."""

from __future__ import annotations

import hashlib
import re
import sys
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataproof.session import shared_dir

BLOCK_BYTES = 8 << 20
#: Digests under one parent of a tree, and blocks that a task hashes.
TREE_FAN, BLOCKS_A_TASK = 1024, 16


def _paths(path: str | list[str]) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def file_name(path_column: str = "path") -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(F.col(path_column), "/"), -1), F.lit("+"), F.lit("%2B")))


def open_file(path: str):
    """A readable file of any storage that ``pyarrow`` knows, with random access."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(unquote(name) if path.startswith("file:") else name)


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in blocks."""
    digest = hashlib.sha256()
    with open_file(path) as file:
        while block := file.read(BLOCK_BYTES):
            digest.update(block)
    return f"sha256:{digest.hexdigest()}"


def listed_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, length`` of every file that is not empty; their contents are not read."""
    files = spark.read.format("binaryFile").load(_paths(path))
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def dataset_manifest(spark: SparkSession, path: str | list[str], format: str) -> DataFrame:
    """``name, format, digest, bytes, source_kind, source_url`` per file.

    Files are hashed on the executors, block by block, one file at a time in a task: any size in the
    same memory. Empty files, which a scan leaves out, come from the listing.
    """
    files = spark.read.format("binaryFile").load(_paths(path))
    names = [(re.sub(r"^file:/+", "file:/", name),) for name in files.inputFiles()]
    listed = spark.createDataFrame(names, "path string")

    def digests(batches):
        for batch in batches:
            batch["digest"] = [file_digest(name) for name in batch["path"]]
            yield batch

    hashed = listed_files(spark, path).mapInPandas(digests, "path string, length long, digest string")
    digest_of_nothing = F.concat(F.lit("sha256:"), F.sha2(F.lit("").cast("binary"), 256))
    return listed.join(hashed, "path", "left").select(
        file_name().alias("name"),
        F.lit(format).alias("format"),
        F.coalesce("digest", digest_of_nothing).alias("digest"),
        F.coalesce("length", F.lit(0)).alias("bytes"),
        F.lit("path").alias("source_kind"),
        F.col("path").alias("source_url"),
    )


def tree_digests(spark: SparkSession, path: str | list[str], block_bytes: int = BLOCK_BYTES, fan: int = TREE_FAN) -> DataFrame:
    """``path, name, bytes, blocks, digest`` per file that is not empty: a digest that many tasks compute for one file.

    Files are cut into blocks, and the blocks of all files are hashed side by side, each by SHA-256. The digests of ``fan``
    neighbours are written one a line and hashed to a parent, level by level, until one is left; a file of one block
    has that block's digest. Block size and fan are part of the digest's name, as others give other digests.
    """
    files = listed_files(spark, path)
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("place"))
    # A fixed number of tasks: what the rows stand for is much larger than they are.
    tasks = max(1, -(-blocks.count() // BLOCKS_A_TASK))

    def hashed(batches):
        for batch in batches:
            found = []
            for name, own in batch.groupby("path", sort=False):
                with open_file(name) as file:
                    for place in own["place"]:
                        file.seek(place * block_bytes)
                        found.append((name, place, hashlib.sha256(file.read(block_bytes)).hexdigest()))
            yield pd.DataFrame(found, columns=["path", "place", "digest"])

    level = blocks.repartition(tasks, "path", "place").mapInPandas(hashed, "path string, place long, digest string")
    folder = shared_dir(spark, "blocks")
    level.write.parquet(folder)
    level = spark.read.parquet(folder)
    most = level.agg(F.max("place")).first()[0] or 0
    while most > 0:
        parents = level.groupBy("path", F.floor(F.col("place") / fan).alias("parent"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]), "\n")
        # A file with one digest left keeps it.
        level = parents.agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max("digest").alias("own"), lines.alias("lines"))
        digest = F.when((F.col("n") == 1) & (F.col("last") == 0), F.col("own")).otherwise(F.sha2("lines", 256))
        level = level.select("path", F.col("parent").alias("place"), digest.alias("digest"))
        most //= fan
    name = F.lit(f"tree-sha256-{block_bytes}-{fan}:")
    found = files.join(level.select("path", "digest"), "path")
    return found.select(
        "path", file_name().alias("name"), F.col("length").alias("bytes"), (last + 1).alias("blocks"), F.concat(name, "digest").alias("digest")
    )


def dataset_digest(manifest: DataFrame) -> DataFrame:
    """``files, bytes, digest`` of a dataset; independent of file names and order.

    One file has its own digest. Several files have the digest of a two-level list: equal
    digests become one line with their count, lines are hashed per leading digits, and the
    at most 4096 group hashes are hashed together. If a file has no digest, neither has the
    dataset.
    """
    lines = manifest.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.sum("bytes").alias("bytes"))
    line = F.concat_ws(" ", "digest", F.col("copies").cast("string"))
    groups = lines.groupBy(F.substring("digest", 8, 3).alias("lead")).agg(
        F.sum("copies").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.max("digest").alias("any"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash"),
    )
    total = groups.agg(
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.max("any").alias("any"),
        F.count_if(F.col("lead").isNull()).alias("unknown"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n"), 256).alias("hash"),
    )
    combined = F.when(F.col("files") == 1, F.col("any")).otherwise(F.concat(F.lit("sha256:"), F.col("hash")))
    return total.select("files", "bytes", F.when(F.col("unknown") == 0, combined).alias("digest"))


# The functions that run on the executors travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
