"""Main text of web pages by wrapper induction (operator 11).

Pages become block trees, and the trees of a host are aligned by simple tree matching. First each tree is folded to its
skeleton, in which children of one shape are one child; pages of a site have few skeletons. Skeletons of a host are
aligned with each other, in groups of some 64, level by level, to one seed tree; nodes that fewer than a 64th of the pages
of a group have are left out, which a node that most pages have survives. Then each skeleton is aligned with
the seed, which tells what slot of the site a block of text stands in. A text that most pages of a host have in one
slot is template: three in five, or nine in ten inside of an article or main part, since articles share passages too. So
is, outside of those, a slot whose few texts take turns or whose text is mostly links. All other texts are content.

Page furniture that names itself (``nav``, ``footer``, roles, class names) is template without a count, since it varies
from page to page as content does. If a page has an ``article``, only that is looked at, else its main part, else all.

Pages that are copies of each other share their texts without being templates. Pages are therefore counted by the
least hash of their five-word windows, which near copies mostly have in common, and hosts with fewer than eight such
pages (sixteen for texts inside of articles) have no constant texts. An article that would lose more than half of itself keeps it all.

Every page is parsed once, in its task. No page text is shuffled unless a host's templates exceed what can be broadcast;
counts are shuffled by host, slot and text, so a host with a third of all pages is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataproof.llm import page_tree
from dataproof.llm.common import Words64, join_small, mix64, settle, text_batches

#: Skeletons aligned in one task at once; nodes of fewer than this part of their pages are left out.
GROUP = 64
#: A host has constant texts from so many different pages on, and so large a part of its pages has them: outside of
#: articles and main parts, and inside of them.
MIN_PAGES, PART = (8, 16), (0.6, 0.9)
WINDOW = 5


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    text = F.coalesce(url, F.lit(""))
    found = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sample(texts: Sequence[str], words: Words64) -> int:
    """The least hash of the windows of five words, the same for most near copies."""
    numbers = np.array([words[w] for text in texts for w in text.split()], dtype=np.uint64)
    width = min(WINDOW, len(numbers))
    if not width:
        return 0
    mixed = np.zeros(len(numbers) - width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = mix64(mixed * np.uint64(31) + numbers[k : len(mixed) + k])
    return int(mixed.min().astype(np.int64))


def page_blocks(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` without ``html``, with ``host``, ``skeleton`` (of the block tree), ``sample`` (a hash that most near copies
    share) and ``blocks``: the texts of the article, or else of the main part, or else of the page, in page order."""
    names = [name for name in df.columns if name != html]
    rows = df.select(*[df[name] for name in names], host_of(df[url]).alias("host_"), F.coalesce(df[html], F.lit("")).alias("html_"))
    fields = [T.StructField("host", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("sample", T.LongType())]
    block = T.StructType([T.StructField("leaf", T.IntegerType()), T.StructField("level", T.IntegerType())])
    block = block.add("links", T.IntegerType()).add("text", T.StringType())
    schema = T.StructType([*rows.schema.fields[:-2], *fields, T.StructField("blocks", T.ArrayType(block))])
    arrow_block = pa.struct([("leaf", pa.int32()), ("level", pa.int32()), ("links", pa.int32()), ("text", pa.string())])

    def run(batches):
        words = Words64()
        for part, texts in text_batches(batches, "html_", max_rows=512):
            found = [_read(text, words) for text in texts]
            columns = [*part.columns[:-1]]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())]
            columns.append(pa.array([x[2] for x in found], pa.list_(arrow_block)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def _read(html: str, words: Words64) -> tuple[str, int, list[tuple[int, int, int, str]]]:
    skeleton, groups = page_tree.fold(page_tree.read_page(html))
    level = max((leaf.level for group in groups for leaf in group), default=0)
    leaves = [(leaf, number) for number, group in enumerate(groups) for leaf in group if leaf.level == level]
    leaves.sort(key=lambda pair: pair[0].place)
    blocks = [(number, leaf.level, leaf.links, leaf.text) for leaf, number in leaves]
    return skeleton, _sample([block[3] for block in blocks], words), blocks


def _merged(rows: pd.DataFrame) -> tuple[str, int]:
    """The seed of aligned skeletons, the commonest first."""
    rows = rows.sort_values(["pages", "tree"], ascending=[False, True])
    total = int(rows["pages"].sum())
    seed = None
    for tree, pages in zip(rows["tree"], rows["pages"]):
        shape = page_tree.read_shape(tree, int(pages))
        if seed is None:
            seed = shape
        else:
            page_tree.align_into(seed, shape)
    page_tree.prune(seed, total / GROUP)
    return page_tree.write_shape(seed), total


def host_seeds(skeletons: DataFrame) -> DataFrame:
    """``host, seed``: the aligned skeletons of each host (``host, skeleton, pages``)."""
    trees = skeletons.select("host", F.col("skeleton").alias("tree"), "pages")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        tree, pages = _merged(rows)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "tree": [tree], "pages": [pages]})

    while True:
        sizes = trees.groupBy("host").agg(F.count("*").alias("trees"))
        many = sizes.where(F.col("trees") > 1)
        most = many.agg(F.max("trees")).first()[0] or 1
        if most == 1:
            return trees.select("host", F.col("tree").alias("seed"))
        parts = F.ceil(F.col("trees") / GROUP)
        grouped = trees.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("tree"), parts))
        alone = grouped.where(F.col("trees") == 1).select("host", "tree", "pages")
        merged = grouped.where(F.col("trees") > 1).groupBy("host", "part").applyInPandas(merge, "host string, tree string, pages long")
        trees = settle(alone.unionByName(merged), "seeds")


def skeleton_slots(skeletons: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, skeleton, slots``: for each leaf of a skeleton, the slot of its host's seed, or -1."""

    def align(batches):
        for batch in batches:
            host, skeleton, seed = (batch.column(name) for name in ("host", "skeleton", "seed"))
            known: dict[str, page_tree.Shape] = {}
            found = []
            for tree, text in zip(skeleton.to_pylist(), seed.to_pylist()):
                if text not in known:
                    known = {text: page_tree.read_shape(text, 0)}
                found.append(page_tree.places(known[text], page_tree.read_shape(tree, 0)))
            yield pa.RecordBatch.from_arrays([host, skeleton, pa.array(found, pa.list_(pa.int32()))], ["host", "skeleton", "slots"])

    joined = skeletons.join(seeds, "host").select("host", "skeleton", "seed")
    return joined.mapInArrow(align, "host string, skeleton string, slots array<int>")


def templates(pages: DataFrame) -> DataFrame:
    """``host, skeleton, leaves, texts`` from the rows of :func:`page_blocks`, where there is anything to leave out: the
    leaves of the skeleton that are template whatever they hold, and the hashes of leaf and text that are."""
    pages = pages.where(F.col("host") != "")
    skeletons = settle(pages.groupBy("host", "skeleton").agg(F.count("*").alias("pages")), "skeletons")
    slots = settle(skeleton_slots(skeletons, host_seeds(skeletons)), "slots")
    blocks = pages.select("host", "skeleton", "sample", F.explode("blocks").alias("b"))
    blocks = blocks.select(
        "host",
        "skeleton",
        "sample",
        F.col("b.leaf").alias("leaf"),
        F.col("b.level").alias("level"),
        F.col("b.links").cast("long").alias("links"),
        F.char_length("b.text").cast("long").alias("chars"),
        F.xxhash64("b.text").alias("text"),
    )
    blocks = join_small(blocks, slots, ["host", "skeleton"], F.col("text"))
    blocks = blocks.withColumn("slot", F.get("slots", "leaf")).where("slot >= 0")
    # First per text and sample, then per text: pages that are copies count once.
    counts = blocks.groupBy("host", "slot", "text", "sample").agg(
        F.max("level").alias("level"), F.sum("links").alias("links"), F.sum("chars").alias("chars")
    )
    counts = counts.groupBy("host", "slot", "text").agg(
        F.count("*").alias("pages"), F.max("level").alias("level"), F.sum("links").alias("links"), F.sum("chars").alias("chars")
    )
    counts = settle(counts, "texts")
    hosts = pages.select("host", "sample").distinct().groupBy("host").agg(F.count("*").alias("samples"))
    constant = join_small(counts, settle(hosts, "hosts"), ["host"], F.col("text"))
    outside, inside = (
        (F.col("samples") >= least) & (F.col("pages") >= part * F.col("samples")) for least, part in zip(MIN_PAGES, PART)
    )
    constant = constant.where(F.when(F.col("level") == 0, outside).otherwise(inside))
    by_slot = counts.groupBy("host", "slot").agg(
        F.max("level").alias("level"),
        F.count("*").alias("texts"),
        F.sum("pages").alias("pages"),
        F.sum("links").alias("links"),
        F.sum("chars").alias("chars"),
    )
    turns = (F.col("pages") >= MIN_PAGES[0]) & (4 * F.col("texts") <= F.col("pages"))
    furniture = by_slot.where((F.col("level") == 0) & (turns | (2 * F.col("links") > F.col("chars"))))
    leaves = slots.select("host", "skeleton", F.posexplode("slots").alias("leaf", "slot"))
    whole = leaves.join(furniture.select("host", "slot"), ["host", "slot"]).select(
        "host", "skeleton", "leaf", F.lit(None).cast("long").alias("text")
    )
    single = leaves.join(constant.select("host", "slot", "text"), ["host", "slot"]).select("host", "skeleton", "leaf", "text")
    found = whole.unionByName(single).groupBy("host", "skeleton")
    return found.agg(
        F.array_sort(F.collect_set(F.when(F.col("text").isNull(), F.col("leaf")))).alias("leaves"),
        F.array_sort(F.collect_set(F.when(F.col("text").isNotNull(), F.xxhash64("leaf", "text")))).alias("texts"),
    )


def extract(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``df`` with ``text``, the main text of each page, and ``n_chars``, its code points, in place of ``html``.

    White space inside a block is one space, blocks are joined by one line break. A null or empty page, and one
    without main text, has the empty text. Pages of a null url, or of one without a host, are read without templates.
    Repeated rows have equal texts; an empty table gives an empty result; columns of any name are kept, but those named
    ``text`` and ``n_chars`` are replaced.
    """
    kept = [name for name in df.columns if name not in (html, "text", "n_chars")]
    inner = df.select(F.struct(*[df[name] for name in kept]).alias("row"), df[url].alias("url"), df[html].alias("html"))
    pages = settle(page_blocks(inner), "pages")
    found = settle(templates(pages), "templates")
    pages = join_small(pages, found, ["host", "skeleton"], F.col("sample"))
    blocks = F.col("blocks")

    def is_content(block: Column) -> Column:
        leaf = F.coalesce(F.array_contains("leaves", block["leaf"]), F.lit(False))
        text = F.coalesce(F.array_contains("texts", F.xxhash64(block["leaf"], F.xxhash64(block["text"]))), F.lit(False))
        return ~(leaf | text)

    def length(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda total, block: total + F.char_length(block["text"]))

    rows = pages.withColumn("content", F.when(F.col("leaves").isNull(), blocks).otherwise(F.filter(blocks, is_content)))
    # An article that is mostly constant is a text that many pages have, not a template.
    copied = (F.get(blocks, F.lit(0))["level"] > 0) & (2 * length(F.col("content")) < length(blocks))
    chosen = F.when(F.coalesce(copied, F.lit(False)), blocks).otherwise(F.col("content"))
    text = F.array_join(F.transform(chosen, lambda block: block["text"]), "\n")
    rows = rows.select("row.*", text.alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
