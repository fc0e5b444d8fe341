"""Removal of benchmark passages from training documents (operator 2).

The windows of the test items (13 consecutive words; a shorter item is one window) are put into hash
tables that every task holds, in blocks of bounded size. Documents are read once per block: their words
become numbers, rolling hashes of their windows are looked up, every hit is verified word by word, and
the words of all hits are marked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import Hashed, mix64, numbered, settle, share, shared, text_batches, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, as a Java character class.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Windows (with their items) in one broadcast block: some 30 MB.
BLOCK_WINDOWS = 200_000

_FROM = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)) + UPPER.encode()
_TABLE = bytes.maketrans(_FROM, b" " * (len(_FROM) - 26) + LOWER.encode())
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def split_words(text: str) -> list[bytes]:
    """The words of a text: in UTF-8 every byte from 0x80 on belongs to a word."""
    return text.encode().translate(_TABLE).split()


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, passage``: the distinct windows of every item, words joined by spaces.

    A null text has no words and no window; a null id counts as the empty text; repeated rows make no
    further windows.
    """
    spaced = F.trim(F.regexp_replace(F.translate(whole_text(items, text), UPPER, LOWER), BETWEEN, " "))
    words = items.select(
        F.coalesce(items[id_column].cast("string"), F.lit("")).alias("item"), F.split(spaced, " ").alias("words"), spaced.alias("spaced")
    ).where("spaced <> ''")

    def passage(start: Column) -> Column:
        return F.array_join(F.slice(F.col("words"), start, window), " ")

    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, passage)).alias("passage")).distinct()


@dataclass
class Index:
    """Hash tables of the windows of one block, by their number of words."""

    words: dict[bytes, int]
    lengths: dict[int, tuple[Hashed, np.ndarray, list[list[str]]]]
    seed: int


def _hashes(ids: np.ndarray, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
    spread = mix64(ids.astype(np.uint64) + np.uint64(seed))
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(0x100000001B3) + spread[starts + k]
    return mix64(out)


def build_index(rows: list[tuple[str, str]]) -> Index:
    """The index of ``(item, passage)`` rows."""
    items: dict[str, list[str]] = {}
    for item, passage in rows:
        items.setdefault(passage, []).append(item)
    words: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[list[int], list[str]]]] = {}
    for passage, owners in items.items():
        ids = [words.setdefault(word, len(words) + 1) for word in passage.encode().split(b" ")]
        by_length.setdefault(len(ids), []).append((ids, owners))
    seed = 1
    while True:  # until no two windows share a hash
        lengths = {}
        for length, found in by_length.items():
            table = np.array([ids for ids, _ in found], dtype=np.int64)
            keys = _hashes(table.ravel(), np.arange(len(found)) * length, length, seed)
            if len(np.unique(keys)) < len(keys):
                break
            lengths[length] = (Hashed(keys, np.arange(len(found))), table, [owners for _, owners in found])
        if len(lengths) == len(by_length):
            return Index(words, lengths, seed)
        seed += 1


def find_hits(texts: list[str], index: Index) -> list[tuple[int, list[int], list[int], list[str]]]:
    """Of every text: its number of words, the starts and ends (in words) of its hits, and the items hit."""
    get = index.words.get
    sizes, parts = [], []
    for text in texts:
        words = split_words(text)
        sizes.append(len(words))
        parts.append(np.fromiter((get(word, 0) for word in words), dtype=np.int64, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int64))  # no window goes on into the next text
    out = [(size, [], [], []) for size in sizes]
    if not texts:
        return out
    ids = np.concatenate(parts)
    first = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)[:-1]])
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    for length, (table, exact, owners) in index.lengths.items():
        starts = np.flatnonzero(unknown[length:] == unknown[:-length]) if len(ids) >= length else np.zeros(0, dtype=np.int64)
        if not len(starts):
            continue
        window = table(_hashes(ids, starts, length, index.seed))
        starts, window = starts[window >= 0], window[window >= 0]
        same = (ids[starts[:, None] + np.arange(length)] == exact[window]).all(axis=1)
        starts, window = starts[same], window[same]
        for text, start, number in zip(np.searchsorted(first, starts, side="right") - 1, starts.tolist(), window.tolist()):
            _, begins, ends, items = out[text]
            begins.append(start - int(first[text]))
            ends.append(begins[-1] + length)
            items.extend(owners[number])
    return out


def _covered(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The spans as a union, in order."""
    union: list[tuple[int, int]] = []
    for begin, end in sorted(zip(begins, ends)):
        if union and begin <= union[-1][1]:
            union[-1] = (union[-1][0], max(union[-1][1], end))
        else:
            union.append((begin, end))
    return union


def mark_hits(df: DataFrame, items: DataFrame, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``df`` with ``n_words``, ``hit_spans`` (array of start and end, in words) and ``hit_items`` (array of ids).

    Columns of these names are replaced. A null text has no words and no hits; an empty item
    table hits nothing; repeated rows are judged row by row. Test items are broadcast in blocks of at
    most ``block_windows`` windows, one pass over the documents a block, so that no broadcast grows with
    the benchmark.
    """
    df = df.drop("n_words", "hit_spans", "hit_items")
    windows = item_windows(items)
    blocks = max(1, -(-windows.count() // block_windows))
    schema = df.schema
    marked = df.select("*", F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"),
                       F.array().cast("array<string>").alias("hit_items"))
    kinds = marked.schema
    for block in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("passage", "item"), F.lit(blocks)) == block) if blocks > 1 else windows
        sent = share(df.sparkSession, build_index([tuple(row) for row in own.collect()]))

        def scan(batches, sent=sent):
            index = shared(sent)
            for part, texts in text_batches(batches, text):
                words, spans, found = [], [], []
                old_spans = part.column(part.num_columns - 2).to_pylist()
                old_items = part.column(part.num_columns - 1).to_pylist()
                for (size, begins, ends, hit), spans_so_far, items_so_far in zip(find_hits(texts, index), old_spans, old_items):
                    words.append(size)
                    begins += [x["start"] for x in spans_so_far]
                    ends += [x["end"] for x in spans_so_far]
                    spans.append([{"start": a, "end": b} for a, b in _covered(begins, ends)])
                    found.append(sorted({*hit, *items_so_far}))
                last = [pa.array(words, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(found, pa.list_(pa.string()))]
                columns = [part.column(i) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(columns + last, names=part.schema.names)

        marked = marked.mapInArrow(scan, kinds)
        if block < blocks - 1:
            marked = settle(marked, "decontaminate")
    return marked


def with_verdict(marked: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated`` (a twentieth of the words or more lie in hits)."""
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("hit_spans", zero, lambda total, span: total + (span["end"] - span["start"]))
    return marked.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    words = [match.span() for match in _WORD.finditer(raw)]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(df: DataFrame, items: DataFrame, remove: str = "documents", text: str = "text") -> DataFrame:
    """``df`` without contaminated documents, or (``remove="spans"``) without the passages hit.

    The columns are those of ``df``. Nulls, repeats and empty tables: see :func:`mark_hits`.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    rows, names = numbered(df)
    at = df.columns.index(text)
    marked = mark_hits(rows, items, names[at])
    if remove == "documents":
        return with_verdict(marked).where(~F.col("contaminated")).select(names).toDF(*df.columns)

    def cut(batches):
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [
                cut_spans(value, [(x["start"], x["end"]) for x in found]) if found else value
                for value, found in zip(batch.column(at).to_pylist(), spans)
            ]
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return marked.select(*names, "hit_spans").mapInArrow(cut, rows.schema).toDF(*df.columns)


def contamination(df: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``df``."""
    rows = df.select(df[id_column].alias("doc_id"), df["text"].alias("text"))
    marked = with_verdict(mark_hits(rows, items))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


