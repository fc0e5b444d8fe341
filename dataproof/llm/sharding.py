"""Byte-balanced shards by Karmarkar-Karp differencing (operator 6).

Documents with equal texts form a group that stays together. Groups are hashed into buckets of bounded
size. In a bucket every group starts as a partial partition (its bytes in one part, nothing in the
others); the two partial partitions with the largest spreads are combined again and again, the largest
part of one with the smallest of the other, until one is left. The partial partitions of the buckets are
combined in the same way, level by level, so no task holds more than one bucket or one fan of buckets.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.common import settle, whole_text

SHARDS = 24
#: Groups in one task, partial partitions in one task, rows numbered in one task.
BUCKET_GROUPS, FAN, SLOT_ROWS = 16384, 4096, 65536


def difference(vectors: np.ndarray) -> np.ndarray:
    """Combines partial partitions (rows of ``vectors``) into one.

    Returns ``place`` of the same shape: part ``j`` of row ``i`` goes to part ``place[i, j]`` of the result.
    Ties take the row that comes first.
    """
    rows, parts = vectors.shape
    # A node keeps its sums from large to small; ``order`` says where they stood before.
    order = [np.argsort(-vector, kind="stable") for vector in vectors]
    sums = [vector[o] for vector, o in zip(vectors, order)]
    children: list[tuple[int, int] | None] = [None] * rows
    heap = [(float(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        turned = np.argsort(-both, kind="stable")
        both = both[turned]
        sums[a] = sums[b] = None
        children.append((a, b))
        order.append(turned)
        sums.append(both)
        heapq.heappush(heap, (float(both[-1] - both[0]), len(sums) - 1))
    place = np.zeros((rows, parts), dtype=np.int64)
    stack = [(len(order) - 1, np.arange(parts))] if rows else []
    while stack:
        node, to = stack.pop()
        before = np.empty(parts, dtype=np.int64)
        before[order[node]] = to  # where the parts go as they stood before they were put in order
        if children[node] is None:
            place[node] = before
        else:
            a, b = children[node]
            stack.append((a, before))
            stack.append((b, before[::-1]))
    return place


def _part_groups(shards: int):
    def part(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["weight", "h1", "h2"], ascending=[False, True, True], kind="stable")
        vectors = np.zeros((len(groups), shards), dtype=np.int64)
        vectors[:, 0] = groups["weight"]
        groups["part"] = difference(vectors)[:, 0].astype(np.int32)
        return groups[["h1", "h2", "bucket", "weight", "part"]]

    return part


def _part_buckets(shards: int):
    def part(sums: pd.DataFrame) -> pd.DataFrame:
        wide = sums.pivot(index="bucket", columns="part", values="weight")
        wide = wide.reindex(columns=range(shards)).fillna(0).sort_index()
        place = difference(wide.to_numpy(dtype=np.int64))
        out = pd.DataFrame({"bucket": np.repeat(wide.index.to_numpy(), shards), "part": np.tile(np.arange(shards), len(wide))})
        out["weight"] = wide.to_numpy(dtype=np.int64).ravel()
        out["parent"] = sums["parent"].iloc[0]
        out["to"] = place.ravel()
        return out.astype({"part": "int32", "to": "int32"})

    return part


def group_shards(groups: DataFrame, shards: int, bucket_groups: int = BUCKET_GROUPS, fan: int = FAN) -> DataFrame:
    """``h1, h2, part``: the shard of every group of ``groups`` (``h1, h2, weight``, one row a group)."""
    buckets = max(1, -(-groups.count() // bucket_groups))
    bucketed = groups.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    parts = bucketed.groupBy("bucket").applyInPandas(
        _part_groups(shards), "h1 long, h2 long, bucket long, weight long, part int"
    )
    parts = settle(parts, "parts")
    sums = parts.groupBy("bucket", "part").agg(F.sum("weight").alias("weight"))
    while buckets > 1:
        buckets = -(-buckets // fan)
        sums = sums.withColumn("parent", F.pmod("bucket", F.lit(buckets)))
        step = sums.groupBy("parent").applyInPandas(
            _part_buckets(shards), "bucket long, part int, weight long, parent long, to int"
        )
        step = settle(step, "levels")
        moved = step.select("bucket", "part", "parent", "to")
        parts = parts.join(moved, ["bucket", "part"]).select("h1", "h2", F.col("parent").alias("bucket"), F.col("to").alias("part"))
        sums = step.groupBy(F.col("parent").alias("bucket"), F.col("to").alias("part")).agg(F.sum("weight").alias("weight"))
    return parts.select("h1", "h2", "part")


def shard(df: DataFrame, shards: int = SHARDS, id_column: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``df``.

    A null text has no bytes and belongs to the group of empty texts; every row adds 8 bytes. Rows with
    equal texts share a shard; groups are told apart by 128 bits of hash. ``slot`` numbers the rows of a
    shard from 0 by a hash of the id, ties by id, checksum and size; rows equal in all of them are
    interchangeable. Null ids are an id of their own. An empty table gives an empty result.
    """
    slot_rows = sizes.pop("slot_rows", SLOT_ROWS)
    value = whole_text(df, text)
    rows = df.select(
        df[id_column].alias("doc_id"),
        (F.octet_length(value) + 8).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("h1"),
        F.xxhash64(F.lit(1), value).alias("h2"),
    )
    rows = settle(rows, "rows")
    groups = settle(rows.groupBy("h1", "h2").agg(F.sum("size").alias("weight")), "groups")
    placed = rows.join(group_shards(groups, shards, **sizes), ["h1", "h2"])
    buckets = max(1, -(-rows.count() // (shards * slot_rows)))
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.col("part").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    )
    placed = settle(placed, "placed")
    in_shard = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("start"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(in_bucket)).join(starts, ["shard", "bucket"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
