"""Exact Jaccard join of word-shingle sets in a metric space (operator 8).

Jaccard distance and the size of the symmetric difference are metrics, and every step uses the triangle
inequality of one of them. Equal sets are one node from the start.

1. *Rings.* The pivot is the empty set: a node's distance to it is its size. Rings are ranges of sizes; a
   node is also replicated to the ring of every size that a linked smaller node can have.
2. *Regions.* In a ring, linked nodes differ in at most ``d`` shingles, which touch at most ``d`` blocks if shingles
   are hashed into blocks. There are so many blocks that a node fills more than ``d`` of them: one of the filled blocks
   is untouched, so linked nodes agree on its content. That content is a pivot, and its region are the nodes at distance
   nought from it within the block. The few nodes that fill too few blocks are hashed anew into twice as many, until
   they fill enough; empty blocks make no regions. (Below 75 per cent too many blocks would be needed; there a region
   is what has one of the first shingles in the order of a hash.)
3. *Stars.* The first node of a region is its pivot; its distance to every other member is computed
   exactly. Linked nodes make components.
4. *Recursion.* Regions whose further members lie in several components go on. Their nodes are dealt into
   finer regions by their locally rarest shingles (linked nodes share one of them). A region takes some
   members as pivots (those that differ least from all others by shingles of their own), computes their
   distances to all members, and falls into Voronoi cells: each member goes to its nearest pivot's cell and, as a boundary node, to
   every cell whose pivot is at most two thresholds farther. Pivots leave, as they are compared with all;
   so do members of a pivot's component that all others are a threshold farther from the pivot than.
   Regions inside one component are done. If the cells would replicate too much (members about equally far
   from all pivots), regions stay whole and only lose their pivots.
5. *Cells.* Of regions with the same members one is kept. What is left of a cell is joined in blocks: sketches of the
   sets are points of a metric space whose distances are never more than the symmetric difference, members are sorted
   by their distance to a pivot in it, and each is held against those within its window. Only members of pairs that no
   bound keeps apart get their sets, and are verified exactly in a task that returns a forest of the links that it has
   found. So no step has a row for each pair of a cell.

Pivots of whole documents alone could not part a corpus: unrelated documents are all at distance one
from each other, so every document would be a boundary document of every cell. Hence steps 1 and 2.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataproof.llm.common import Words64, discard, mix64, numbered, settle, share, shared, text_batches, whole_text

SHINGLE = 3
PERCENT = 90
#: Ratio of the sizes that bound a ring; the similarity from which on shingles are blocked.
RING, LEAST_BLOCKED = 1.25, 75
#: Bits of the filter that spares later passes most documents without candidates: 4 MB in all.
FILTER_BITS = 1 << 25
#: Buckets of a sketch; members of a region that are compared at once, with as many others, and their shingles.
BUCKETS, CHUNK, CHUNK_SHINGLES = 256, 1024, 1 << 19

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(text: str, numbers: Words64, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit numbers; fewer words than ``width`` are one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total = total * _ODD[0] + ids[k : len(words) - size + 1 + k] * _ODD[1]
            total ^= total >> np.uint64(29)
    return np.unique(mix64(total))


def set_number(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        first = mix64(shingles + _ODD[1]).sum(dtype=np.uint64)
        second = mix64(shingles ^ _ODD[2]).sum(dtype=np.uint64)
    return int(first.astype(np.int64)), int(second.astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of ``BUCKETS`` hashed buckets, at most 65535.

    The sum of the differences of two sketches is a metric, and never more than the symmetric difference.
    """
    counts = np.bincount((mix64(shingles + _ODD[2]) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 65535).astype(np.uint16).tobytes()


def near_pairs(sizes: np.ndarray, slacks: np.ndarray, labels: np.ndarray, sketches: np.ndarray, percent: int):
    """Yields each row with the later rows that it may be linked with, by sizes, slacks and sketches.

    The first row is the pivot: only rows within the window of its distances to it are looked at. ``labels`` may change
    on the way: rows with one label are not held against each other from then on.
    """
    share = (100 - percent) / (100 + percent)
    to_pivot = np.abs(sketches - sketches[0]).sum(axis=1)
    order = np.argsort(to_pivot, kind="stable")
    ordered, largest = to_pivot[order], sizes.max()
    for place, row in enumerate(order):
        window = ordered[place] + share * (sizes[row] + largest) + 1e-6
        others = order[place + 1 : np.searchsorted(ordered, window, side="right")]
        others = others[(labels[others] != labels[row]) & (slacks[others] + slacks[row] >= 0)]
        apart = np.abs(sketches[others] - sketches[row]).sum(axis=1)
        others = others[apart <= share * (sizes[others] + sizes[row]) + 1e-6]
        if len(others):
            yield row, others


def forest(sets: list, sizes: np.ndarray, slacks: np.ndarray, labels: np.ndarray, sketches: np.ndarray, sides: np.ndarray | None, percent: int):
    """Two arrays of rows: links between rows of different ``labels`` which connect all that linked rows connect, without
    a circle. With ``sides``, only links from one side to another."""
    labels, left, right = labels.copy(), [], []
    ends = np.cumsum(np.concatenate([[0], sizes]))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(values), dtype=bool)
    for row, others in near_pairs(sizes, slacks, labels, sketches, percent):
        if sides is not None:
            others = others[sides[others] != sides[row]]
        if not len(others):
            continue
        own[flat[ends[row] : ends[row + 1]]] = True
        both = np.array([np.count_nonzero(own[flat[ends[x] : ends[x + 1]]]) for x in others])
        own[flat[ends[row] : ends[row + 1]]] = False
        others = others[100 * both >= percent * (sizes[others] + sizes[row] - both)]
        names, first = np.unique(labels[others], return_index=True)
        left += [row] * len(first)
        right += others[first].tolist()
        labels[np.isin(labels, names)] = labels[row]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def ring_bounds(percent: int, largest: int = 1 << 40) -> list[int]:
    """The least size of each ring. Smaller sets are linked with equal sets only."""
    bounds = [-(-percent // (100 - percent))]
    while bounds[-1] < largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * RING)))
    return bounds


#: Numbers of blocks that have been looked for. A plain dictionary travels with the functions that use it.
_BLOCKS: dict[tuple[int, int], int] = {}


def block_number(least: int, allowed: int) -> int:
    """So many blocks that nearly every set of ``least`` shingles fills more than ``allowed`` of them."""
    if (least, allowed) not in _BLOCKS:
        _BLOCKS[least, allowed] = _fewest_blocks(least, allowed)
    return _BLOCKS[least, allowed]


def _fewest_blocks(least: int, allowed: int) -> int:
    blocks = allowed + 1
    while True:
        load = least / blocks
        empty = math.exp(-load)
        spread = math.sqrt(max(0.0, blocks * empty * (1 - (1 + load) * empty)))
        if blocks * (1 - empty) - 2 * spread >= allowed + 1:
            return blocks
        blocks += max(1, blocks // 50)


def region_keys(shingles: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """The regions of one set, as 64-bit numbers. No region stands for an empty block."""
    size = len(shingles)
    if size < bounds[0]:
        return np.zeros(0, dtype=np.uint64)
    least = max(-(-percent * size // 100), bounds[0])
    if percent < LEAST_BLOCKED:
        # The first shingles in an order by hashes; linked sets have one of them in common.
        return np.sort(mix64(shingles ^ _ODD[0]))[: size - least + 1]
    content_of = mix64(shingles ^ _ODD[0])
    out = []
    for ring in range(bisect_right(bounds, least) - 1, bisect_right(bounds, size)):
        allowed = (100 - percent) * (bounds[ring + 1] - 1) // percent
        blocks, filled, level = block_number(bounds[ring], allowed), 0, 0
        while filled <= allowed:
            seed = mix64(np.array([(ring << 32) + level + 1], dtype=np.uint64))[0]
            with np.errstate(over="ignore"):
                block = mix64(shingles + seed) % np.uint64(blocks)
                order = np.argsort(block)
                block = block[order]
                starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                content = np.add.reduceat(content_of[order], starts)
                out.append(mix64(content ^ mix64(seed + block[starts])))
            filled, level, blocks = len(starts), level + 1, 2 * blocks
    return np.concatenate(out)


def _signatures(df: DataFrame, id_column: str, text: str, percent: int, width: int) -> DataFrame:
    """``row, doc_id, mark, n, h1, h2, keys`` of every row; ``row`` is a number of its own.

    ``keys`` are the regions of the set, so that texts are cut into shingles once for both; none if a task has met the
    set before.
    """

    def sign(batches):
        numbers, bounds, met = Words64(), ring_bounds(percent), set()
        for part, texts in text_batches(batches, max_rows=512):
            sets = [shingle_set(value, numbers, width) for value in texts]
            numbers_of = [set_number(found) for found in sets]
            keys = []
            for found, name in zip(sets, numbers_of):
                if name in met:
                    keys.append(np.zeros(0, dtype=np.uint64))
                    continue
                if len(met) >= Words64.limit:
                    met.clear()
                met.add(name)
                keys.append(region_keys(found, percent, bounds))
            columns = [part.column(i) for i in range(3)] + [pa.array(list(map(len, sets)), pa.int64())]
            columns += [pa.array([x[i] for x in numbers_of], pa.int64()) for i in (0, 1)]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "mark", "n", "h1", "h2", "keys"])

    rows = _marked(df, id_column, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "mark", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(sign, f"row long, doc_id {kind}, mark long, n long, h1 long, h2 long, keys array<long>")
    return settle(signed, "signatures", hashes=True)


def _regions(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node, pivot``: the members of all regions of two nodes or more; the pivot is the first of them.

    Keys are shuffled with so many bits of the set's hash only as tell most nodes apart (the rest of 64 would cost more
    than all else that is written), and nodes join those that are not alone. If two nodes agree in these bits, both
    join, which adds members but loses none.
    """
    mask = (1 << min(63, nodes.count().bit_length() + 10)) - 1
    short = F.col("h1").bitwiseAND(F.lit(mask)).alias("short")
    found = signed.select(F.explode("keys").alias("key"), short)
    shared_by = F.count("*").over(Window.partitionBy("key"))
    found = found.withColumn("times", shared_by).where(F.col("times") > 1).select("key", "short")
    members = found.join(nodes.select(short, "node"), "short")
    members = settle(members.select("key", "node").distinct(), "members")
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last")
    return settle(members.join(pivots.select("key", "pivot"), "key"), "regions")


def _marked(df: DataFrame, id_column: str, text: str) -> DataFrame:
    value = whole_text(df, text)
    return df.select(df[id_column].alias("doc_id"), F.xxhash64(df[id_column], value).alias("mark"), value.alias("text"))


def _sets(df: DataFrame, wanted: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """``node, n, shingles, sketch`` of the nodes of ``wanted`` (``node, mark, h1, h2``), from one more pass over the texts.

    A filter of a fixed number of bits goes to all tasks; documents that pass it by chance go at the join.
    """
    place = F.pmod("mark", F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(mark, {FILTER_BITS}) % 64 as int))")
    parts = wanted.select((place / 64).cast("long").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    known = parts.toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[known["at"].to_numpy(dtype=np.int64)] = known["bits"].to_numpy(dtype=np.int64).astype(np.uint64)
    sent = share(df.sparkSession, bits)

    def cut(batches):
        bits, numbers = shared(sent), Words64()
        for batch in batches:
            at = np.asarray(batch.column(1)).astype(np.int64) % FILTER_BITS
            passed = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(passed.astype(bool)))
            for _, texts in text_batches([batch]) if batch.num_rows else ():
                sets = [shingle_set(value, numbers, width) for value in texts]
                numbers_of = [set_number(found) for found in sets]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                arrays = [pa.array([x[i] for x in numbers_of], pa.int64()) for i in (0, 1)]
                flat = pa.array(np.concatenate(sets).astype(np.int64))
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                arrays.append(pa.array([sketch(found) for found in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "shingles", "sketch"])

    rows = _marked(df, id_column, text).select("doc_id", "mark", "text")
    rows = rows.select(F.lit(0).alias("zero"), "mark", "text")
    found = rows.mapInArrow(cut, "h1 long, h2 long, shingles array<long>, sketch binary")
    found = wanted.select("node", "h1", "h2").join(found, ["h1", "h2"])
    # By the join's keys too, so that sets are not shuffled again.
    found = found.groupBy("h1", "h2", "node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
    return settle(found.select("node", F.size("shingles").alias("n"), "shingles", "sketch"), "sets")


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` with the nodes of ``nodes``, and by chance some others: a filter of a fixed number of bits
    (``FILTER_BITS`` / 64 rows at most are broadcast) spares the other sets a shuffle."""
    place = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    at = F.shiftright(place, 6)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node), {FILTER_BITS}) % 64 as int))")
    parts = nodes.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found = sets.withColumn("at", at).join(F.broadcast(parts), "at")
    return found.where(F.col("bits").bitwiseAND(bit) != 0).select(sets.columns)


def _distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, distance, linked`` of the pairs ``a, b``, exactly."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b") - both).alias("either"))
    return counted.select(
        "a", "b", (1 - F.col("both") / F.col("either")).alias("distance"), (100 * F.col("both") >= percent * F.col("either")).alias("linked")
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the least node that it is connected with) of every node with an edge ``a, b``.

    Large-star and small-star steps in turn until nothing changes; the edges never grow in number.
    """

    def stars(current: DataFrame) -> DataFrame:
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return small.union(low.select("u", F.col("m").alias("v"))).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    current = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(current)
    while before[0]:
        current = settle(stars(current), "stars")
        if (now := state(current)) == before:
            break
        before = now
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _rare_regions(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, node, slack``: regions around each node's locally rarest shingles.

    In one order of all shingles, linked sets share one of their first ``n - ceil(percent * n / 100) + 1``.
    A shingle that no other node has is in the symmetric difference with every other node. What a node
    brings to the difference that a link may have at most, less its own such shingles, is its slack: two
    nodes whose slacks add up to less than nought are not linked. Some more nodes may be among those of ``nodes``.
    """
    rows = _only(sets, nodes).select("node", F.explode("shingles").alias("key"))
    rows = rows.withColumn("count", F.count("*").over(Window.partitionBy("key")).cast("int")).where("count > 1")
    # Shingles that no other node has come first in the order; they need not be shuffled to be counted.
    of_node = Window.partitionBy("node")
    ranked = rows.withColumns({"with_others": F.count("*").over(of_node), "place": F.row_number().over(of_node.orderBy("count", "key"))})
    ranked = ranked.join(sets.select("node", "n"), "node")
    alone = F.col("n") - F.col("with_others")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    slack = F.col("n") * ((100 - percent) / (100 + percent)) - alone + 1e-6
    return ranked.where(F.col("place") <= keep - alone).select("key", "node", slack.alias("slack"))


def _unlike(regions: DataFrame) -> DataFrame:
    """Of regions with the same members, told apart by 128 bits, one: texts with a passage in common share all its shingles."""
    marks = [F.expr("bit_xor(xxhash64(node))").alias("mark"), F.expr("bit_xor(xxhash64(1, node))").alias("other_mark")]
    found = regions.groupBy("key").agg(F.count("*").alias("members"), *marks)
    return regions.join(found.groupBy("members", "mark", "other_mark").agg(F.min("key").alias("key")).select("key"), "key")


def _open(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of regions that may still have links between components, with their ``label``.

    Their members lie in several components, and not all of them have a negative slack.
    """
    rows = _with_labels(regions, labels)
    slack = F.max("slack") if "slack" in regions.columns else F.lit(0)
    ends = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), slack.alias("most"))
    return rows.join(ends.where("low < high AND most >= 0").select("key"), "key")


def _ends(left: str, right: str) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node, label``) after the components that ``links`` (``a, b``) connect are one."""
    ends = [labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").where("label_a <> label_b")
    between = settle(between.select(*_ends("label_a", "label_b")).distinct(), "between")
    if not between.head(1):
        return labels
    joined = components(between).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    moved = labels.join(joined, "label", "left").select("node", F.coalesce("whole", "label").alias("label"))
    return settle(moved, "labels")


def _met(rows: DataFrame, found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``key, node, slack, pivot, distance`` of what may go on of ``rows`` (``key, node, slack, pivot``).

    A member in its pivot's component goes no further if all members of other components are more than a
    threshold farther from the pivot than it is: by the triangle inequality it is linked with none of them.
    """
    met = rows.select("key", "node", "slack", "pivot", *_ends("node", "pivot"))
    met = met.join(found.select("a", "b", "distance"), ["a", "b"]).drop("a", "b").join(labels, "node")
    met = met.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot")
    own = F.col("label") == F.col("pivot_label")
    others = met.groupBy("key", "pivot").agg(F.min(F.when(~own, F.col("distance"))).alias("other"))
    met = met.join(others, ["key", "pivot"])
    alone = own & (F.col("other").isNull() | (F.col("distance") + ((100 - percent) / 100 + 1e-9) < F.col("other")))
    met = settle(met.select("key", "node", "slack", "pivot", "distance", "label", alone.alias("alone")), "met")
    gone = met.where("alone").select("key", "node").union(met.select("key", "pivot")).distinct()
    return met.drop("alone").join(gone, ["key", "node"], "left_anti")


def _cells(met: DataFrame, percent: int) -> DataFrame:
    """``key, node, slack``: the Voronoi cells of each region around its pivots, boundary nodes in several.

    Regions stay whole for a round if the cells of all of them had a quarter more rows.
    """
    near = met.groupBy("key", "node").agg(
        F.first("slack").alias("slack"),
        F.min("distance").alias("near"),
        F.collect_list(F.struct("pivot", "distance")).alias("all"),
    )
    window = 2 * (100 - percent) / 100 + 1e-9
    near = near.select("key", "node", "slack", F.filter("all", lambda x: x["distance"] <= F.col("near") + window).alias("cells"))
    near = settle(near, "cells")
    rows, replicas = near.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
    if 4 * replicas > 5 * rows:
        return near.select("key", "node", "slack")
    cells = near.select("key", "node", "slack", F.explode("cells").alias("cell"))
    return cells.select(F.xxhash64("key", "cell.pivot").alias("key"), "node", "slack")


def link_components(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """``row, doc_id, mark, n_shingles, component_id, component`` of every row of ``df``.

    Two rows are linked if their shingle sets have a Jaccard similarity of ``percent`` per cent or more.
    ``component_id`` is the least id among the rows that a row reaches by links, itself included; null
    ids are passed over. Rows without words (null, empty or blank texts) are linked with nothing. Rows
    with equal sets are linked, repeated rows too. Further columns are not read; an empty table gives an
    empty result. Shingles and sets are told apart by 64 and 128 bits of hash.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent lies between 50 and 99")
    with_keys = _signatures(df, id_column, text, percent, width)
    signed = settle(with_keys.drop("keys"), "signed")
    nodes = signed.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
    nodes = settle(nodes, "nodes")
    members = _regions(with_keys, nodes)
    discard(with_keys)

    candidates = signed.select(F.col("row").alias("node"), "mark", "h1", "h2").join(members.select("node").distinct(), "node")
    sets = _sets(df, settle(candidates, "candidates"), id_column, text, width)
    star = members.where("node <> pivot").withColumn("slack", F.lit(0.0))
    pairs = star.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found = settle(_distances(pairs, sets, percent), "distances")
    own = sets.select("node", F.col("node").alias("label"))
    labels = _merged(own, found.where("linked").select("a", "b"))

    # Regions that lie in one component by now are done; groups of near copies share very many.
    ends = _with_labels(members.select("key", "node"), labels).groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    star = star.join(settle(ends.where("low < high").select("key"), "open"), "key")
    rest = _met(star, found, labels, percent).select("key", "node", "slack")
    open_nodes = settle(_open(rest, labels).select("node").distinct(), "open")
    if open_nodes.head(1):
        labels = _finish(settle(_rare_regions(open_nodes, sets, percent), "rare"), labels, sets, percent)

    named = _with_labels(nodes.select("h1", "h2", "n", "node", "least_id"), labels)
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "label").select("h1", "h2", "n", "component_id", F.col("label").alias("component"))
    out = signed.join(named, ["h1", "h2", "n"], "left")
    return out.select(
        "row",
        "doc_id",
        "mark",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component", "row").alias("component"),
    )


def _finish(regions: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, pivots: int = 4) -> DataFrame:
    """The labels after all regions are joined to the end."""
    rows = settle(_unlike(settle(_open(regions, labels), "open")), "rows")
    # The members with the most slack are pivots, one of each component before the second of any.
    in_label = F.row_number().over(Window.partitionBy("key", "label").orderBy(F.desc("slack"), "node"))
    best = rows.where("slack >= 0").withColumn("turn", in_label).where(F.col("turn") <= pivots)
    place = F.row_number().over(Window.partitionBy("key").orderBy("turn", F.desc("slack"), "node"))
    best = best.withColumn("place", place).where(F.col("place") <= pivots)
    chosen = settle(best.select("key", F.col("node").alias("pivot")), "pivots")
    star = rows.select("key", "node", "slack").join(chosen, "key").where("node <> pivot")
    found = settle(_distances(star.select(*_ends("node", "pivot")).distinct(), _only(sets, rows), percent), "distances")
    labels = _merged(labels, found.where("linked").select("a", "b"))
    cells = settle(_open(_cells(_met(star, found, labels, percent), percent), labels), "open")
    return _merged(labels, settle(_links_left(_unlike(cells), sets, percent), "links"))


def _links_left(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between members of different components, as many as connect what is connected by links.

    A cell is hashed into chunks, and a task compares two chunks, or one with itself.
    """
    cells = settle(cells.join(sets.select("node", "n"), "node"), "cells")
    most = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES))
    rows = cells.join(cells.groupBy("key").agg(most.alias("chunks")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    rows = rows.drop("other", "chunks")
    names = rows.columns

    def parts(found):
        found = found.sort_values("node")
        sketches = np.stack([np.frombuffer(x, dtype=np.uint16) for x in found["sketch"]]).astype(np.int32)
        sides = found["own"].to_numpy() if found["low"].iloc[0] != found["high"].iloc[0] else None
        return found, [*(found[name].to_numpy() for name in ("n", "slack", "label")), sketches, sides]

    def near(found):
        found, (*columns, sides) = parts(found)
        kept = np.zeros(len(found), dtype=bool)
        for row, others in near_pairs(*columns, percent):
            if sides is not None:
                others = others[sides[others] != sides[row]]
            kept[others] = True
            kept[row] |= len(others) > 0
        return found.loc[kept, names]

    def compare(found):
        import pandas as pd

        found, columns = parts(found)
        left, right = forest(found["shingles"].tolist(), *columns, percent)
        nodes = found["node"].to_numpy()
        pairs = nodes[left], nodes[right]
        return pd.DataFrame({"a": np.minimum(*pairs), "b": np.maximum(*pairs)})

    block = ["key", "low", "high"]
    rows = rows.join(sets.select("node", "sketch"), "node").groupBy(*block).applyInPandas(near, rows.schema)
    rows = settle(rows, "near")
    rows = rows.join(_only(sets.select("node", "shingles", "sketch"), rows), "node")
    return rows.groupBy(*block).applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; see :func:`link_components`."""
    return link_components(df, percent=percent).select("doc_id", "n_shingles", "component_id")


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = SHINGLE
) -> DataFrame:
    """``df`` with one row of each component: the one with the least id (null ids last), ties by a hash of the row.

    Of rows with equal ids and texts one is kept. Rows without words all stay.
    """
    found = link_components(df, id_column, text, percent, width)
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"), F.col("row"))
    kept = found.groupBy("component").agg(F.min(best).alias("best")).select(F.col("best.mark").alias("mark"))
    kept = kept.groupBy("mark").agg(F.count("*").alias("kept_rows"))
    rows, names = numbered(df)
    value, own = whole_text(rows, names[df.columns.index(text)]), F.col(names[df.columns.index(id_column)])
    joined = rows.withColumn("mark", F.xxhash64(own, value)).join(kept, "mark")
    # Rows equal in id and text share a mark: as many of them stay as components chose that mark.
    place = F.row_number().over(Window.partitionBy("mark").orderBy(F.lit(0)))
    return joined.withColumn("place", place).where("place <= kept_rows").select(names).toDF(*df.columns)
