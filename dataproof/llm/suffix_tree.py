"""Language-model scores by a probabilistic suffix tree (operator 10).

The symbols of the tree are phrases: a text is cut behind every word whose hash is a multiple of ``ANCHOR`` and at its
end, so that a passage is cut alike wherever it stands. A state is a context of none to ``PHRASES`` phrases. Its counts are
tables that grow with the corpus: a phrase is kept in a state if training has met it there twice or more, and a context
of one phrase or more is kept if it has such phrases and what they gain over its suffix, in nats of likelihood, is enough.
The distribution of a state gives the kept phrases their counts, and what training met once, and one more, goes to the
distribution of its suffix; it adds up to one in every state. A phrase is scored in the state of the longest kept
suffix of what stands before it. Below all states a phrase is spelt word by word.

Words are symbols of their own there: a word with what ends it (a space or the end) has the mixed probability of its share
among the training words and of its spelling. Spellings come from a suffix tree over bytes: training counts every byte
with the ``DEPTH`` bytes before it; a context is kept if it stands for a fixed part of all bytes at least, and if its
next-byte distribution diverges from that of its longest suffix, or if a longer kept context needs it.

Phrases that training has met twice are looked for with a filter of fixed size, so only phrases that a kept one may
concern are shuffled; the rest of a text's score is added up where the text is.

Beside it runs the unigram base over words. Words too rare for a broadcast table get their counts in a
shuffle, by 64-bit hashes, as do phrases.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import Hashed, crc_remainder, discard, hashes64, mix64, settle, share, shared, text_batches, whole_text

DEPTH = 5
#: A context must stand for this part of all bytes: at most ``DEPTH * PART`` contexts, whatever the corpus.
PART = 16384
#: A context is kept if its divergence from its suffix, in bits, times its share of the bytes is at least this.
GAIN = 1e-6
#: Weight of the suffix's distribution, in observations for each distinct next byte.
BACK = 1.0
#: Words whose counts are broadcast, from a sample of one text in ``SAMPLE``.
FREQUENT, SAMPLE = 131072, 16
#: How much the word shares weigh against the spelling.
TRUST = 0.95
#: One word in so many ends a phrase; phrases of the longest context; the least gain of a context, in nats.
ANCHOR, PHRASES, LEAST_GAIN = 8, 2, 2.0
#: Bits of the filter of phrases met twice: 4 MB.
FILTER_BITS = 1 << 25
#: Text that is worked on at once, of which each byte takes some hundred bytes of memory; rows of phrases likewise.
RUN_BYTES, RUN_ROWS = 1 << 19, 2048
END, SPACE = 10, 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLANK = np.isin(np.arange(256), [SPACE, *range(9, 14)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Run:
    """Texts in one run of bytes: each as ``DEPTH`` ends, its lower-cased words parted by spaces, and an end.

    ``sizes`` are the numbers of words of the texts. Symbols are the words and, for a text without words, an empty one;
    ``ends`` are the places behind them. ``letters`` are the bytes of the words alone.
    """

    data: np.ndarray
    sizes: np.ndarray
    ends: np.ndarray
    letters: np.ndarray

    @cached_property
    def symbols(self) -> np.ndarray:
        """The numbers of symbols of the texts."""
        return np.maximum(self.sizes, 1)

    @cached_property
    def firsts(self) -> np.ndarray:
        """The places of the symbols' first bytes."""
        symbols, firsts = self.symbols, np.zeros(len(self.ends), dtype=np.int64)
        firsts[1:] = self.ends[:-1] + 1
        firsts[np.cumsum(symbols) - symbols] += DEPTH
        return firsts

    @cached_property
    def counted(self) -> np.ndarray:
        """Which bytes are not those before a text."""
        counted, begins = np.ones(len(self.data), dtype=bool), self.firsts[np.cumsum(self.symbols) - self.symbols]
        for k in range(1, DEPTH + 1):
            counted[begins - k] = False
        return counted


def run_of(texts: list[bytes]) -> Run:
    start, end = bytes([END]) * DEPTH, bytes([END])
    data = np.frombuffer(b"".join([start + x + end for x in texts]).translate(_LOWER), dtype=np.uint8)
    stops = np.cumsum([len(x) + DEPTH + 1 for x in texts])
    blank = _BLANK[data]
    behind = blank.copy()  # of a word
    behind[:1] = False
    behind[1:] &= ~blank[:-1]
    at = np.flatnonzero(behind)
    sizes = np.diff(np.searchsorted(at, np.concatenate([[0], stops])))
    letters = data[~blank]
    data = data.copy()
    data[at] = SPACE
    data[at[np.cumsum(sizes)[sizes > 0] - 1]] = END
    behind[stops[sizes == 0] - 1] = True
    kept = behind | ~blank
    for k in range(DEPTH):
        kept[np.concatenate([[0], stops[:-1]]) + k] = True
    return Run(data[kept], sizes, np.flatnonzero(behind[kept]), letters)


def _codes(run: Run) -> np.ndarray:
    """Every byte of the texts as a number with the ``DEPTH`` bytes before it.

    Before a text stand ends. The lowest byte of a number is the byte itself.
    """
    padded = np.concatenate([np.zeros(7 - DEPTH, dtype=np.uint8), run.data])
    windows = np.ndarray(max(0, len(padded) - 7), dtype=">u8", buffer=padded, strides=(1,))  # one for each byte that DEPTH stand before
    return windows[run.counted[DEPTH:]].astype(np.uint64) & np.uint64(_mask(DEPTH + 1))


def _runs(texts: list[str], size: int = RUN_BYTES):
    """Parts of ``texts`` of some ``size`` characters, as runs; at least one text each."""
    part, length = [], 0
    for text in texts:
        part.append(text.encode())
        length += len(text)
        if length >= size:
            yield run_of(part)
            part, length = [], 0
    if part:
        yield run_of(part)


class _Sums:
    """Counts by number, merged now and then, so that memory stays bounded."""

    def __init__(self, most: int = 1 << 20):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.total, self.most = 0, most

    def add(self, keys: np.ndarray) -> bool:
        """Adds one for each key; true if it is time to empty the counts."""
        found = np.unique(keys, return_counts=True)
        self.held.append(found)
        self.total += len(found[0])
        if self.total <= 2 * self.most:
            return False
        self._merge()
        return self.total > self.most

    def _merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        order = np.argsort(keys, kind="stable")  # sorted parts, which it merges
        keys, counts = keys[order], counts[order]
        firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        keys, counts = keys[firsts], np.add.reduceat(counts, firsts)
        self.held, self.total = [(keys, counts)], len(keys)

    def empty(self):
        if self.held:
            self._merge()
            keys, counts = self.held[0]
            self.held, self.total = [], 0
            for i in range(0, len(keys), 65536):
                yield keys[i : i + 65536].astype(np.int64), counts[i : i + 65536]


#: Kinds of counts.
BYTES, WORDS, TEXTS, RARE = 0, 1, 2, 3


def corpus_counts(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``kind, key, n`` over the texts of ``rows`` (``text``).

    How often each byte follows each ``DEPTH`` bytes, how often each of the ``frequent`` words and each other
    one occurs, and the numbers of words (key 0) and of texts (key 1).
    """
    sent = share(rows.sparkSession, Hashed(frequent, np.arange(len(frequent))))

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(keys), kind, dtype=np.int32))
        return pa.RecordBatch.from_arrays([kinds, pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

    def count(batches):
        place, sums, rare = shared(sent), _Sums(), _Sums(1 << 19)
        often, totals = np.zeros(len(frequent), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for _, texts in text_batches(batches, max_bytes=4 * RUN_BYTES):
            for part in _runs(texts):
                ids = _numbers(part)
                found = place(ids)
                often += np.bincount(found[found >= 0], minlength=len(frequent))
                totals += (len(ids), len(part.sizes))
                for kind, held, keys in ((BYTES, sums, _codes(part)), (RARE, rare, ids[found < 0])):
                    if held.add(keys):
                        for keys, counts in held.empty():
                            yield out(kind, keys, counts)
        for kind, held in ((BYTES, sums), (RARE, rare)):
            for keys, counts in held.empty():
                yield out(kind, keys, counts)
        seen = np.flatnonzero(often)
        yield out(WORDS, frequent[seen].astype(np.int64), often[seen])
        yield out(TEXTS, np.arange(2), totals)

    counted = rows.select("text").mapInArrow(count, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _numbers(run: Run) -> np.ndarray:
    """The words of the texts as 64-bit numbers; each different one of a run is hashed once."""
    lengths = run.ends - run.firsts
    offsets = np.concatenate([[0], np.cumsum(lengths[lengths > 0])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(run.letters)])
    coded = words.dictionary_encode()
    return hashes64(coded.dictionary)[coded.indices.to_numpy()]


@dataclass
class Tree:
    """The states of the kept contexts.

    ``contexts[d]`` finds the state of a kept context of ``d`` bytes; ``states`` has, for every state, the
    natural logarithm of the probability of each next byte, in the column that ``columns`` gives. Bytes
    that training has not seen share a column and its probability. ``steps`` has, for every state, the state whose
    context has one byte more before it, by that byte's column, or -1.
    """

    contexts: list[Hashed]
    states: np.ndarray
    columns: np.ndarray
    steps: np.ndarray


def _mask(length: int) -> int:
    return (1 << (8 * length)) - 1


def context_counts(counts: DataFrame) -> DataFrame:
    """``size, context, next, n`` of all contexts that stand for a ``PART``-th of all bytes, and the empty one."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    next_byte = F.col("code").bitwiseAND(255).alias("next")
    rows = counts.select(F.shiftright("code", 8).alias("whole"), next_byte, "n")
    sizes = F.array(*[F.struct(F.lit(d).alias("size"), F.col("whole").bitwiseAND(_mask(d)).alias("context")) for d in range(DEPTH + 1)])
    rows = rows.select(F.explode(sizes).alias("c"), "next", "n").select("c.size", "c.context", "next", "n")
    rows = rows.groupBy("size", "context", "next").agg(F.sum("n").alias("n"))
    rows = settle(rows, "contexts")
    often = rows.groupBy("size", "context").agg(F.sum("n").alias("all")).where(F.col("all") * PART >= total)
    return rows.join(often, ["size", "context"])


def fit(counts: DataFrame) -> Tree:
    """The tree of byte counts ``code, n``."""
    child = settle(context_counts(counts), "kept")
    parent = child.select(
        (F.col("size") + 1).alias("size"),
        F.col("context").alias("suffix"),
        "next",
        (F.col("n") / F.col("all")).alias("expected"),
    )
    longer = child.where("size > 0").withColumn(
        "suffix", F.expr(f"context & (CASE size {' '.join(f'WHEN {d} THEN {_mask(d - 1)}L' for d in range(1, DEPTH + 1))} END)")
    )
    share_of = F.col("n") / F.col("all")
    gains = longer.join(parent, ["size", "suffix", "next"]).groupBy("size", "context").agg(
        (F.sum(share_of * F.log2(share_of / F.col("expected"))) * F.max("all")).alias("gain")
    )
    total = child.where("size = 0").agg(F.sum("n")).first()[0] or 0
    told = gains.where(F.col("gain") >= GAIN * total).select("size", "context").toPandas()
    found = child.toPandas()  # at most DEPTH * PART contexts with the bytes that follow them
    return build(found, told)


def build(found, told) -> Tree:
    """The tree of the counts ``size, context, next, n`` and of the contexts that passed the test."""
    wanted: list[set[int]] = [set() for _ in range(DEPTH + 1)]
    wanted[0].add(0)
    for size, context in zip(told["size"].tolist(), told["context"].tolist()):
        for d in range(1, size + 1):
            wanted[d].add(context & _mask(d))
    seen = np.unique(found["next"].to_numpy(dtype=np.int64))
    width, unseen = len(seen) + 1, 256 - len(seen)
    columns = np.full(256, width - 1)
    columns[seen] = np.arange(len(seen))
    # The even distribution; the last column has the probability of one unseen byte.
    below = np.full((1, width), 1 / 256)
    contexts, states, steps, before = [], [], [], {}
    first = 0
    for d in range(DEPTH + 1):
        keys = sorted(wanted[d])
        place = {key: i for i, key in enumerate(keys)}
        contexts.append(Hashed(np.array(keys, dtype=np.uint64), np.arange(first, first + len(keys))))
        first += len(keys)
        own = found[found["size"] == d]
        at = np.array([place.get(x, -1) for x in own["context"].tolist()], dtype=np.int64)
        counts = np.zeros((len(keys), width))
        counts[at[at >= 0], columns[own["next"].to_numpy(dtype=np.int64)[at >= 0]]] = own["n"].to_numpy()[at >= 0]
        steps.append(np.full((len(keys), width), -1, dtype=np.int32))
        if d:
            suffixes = [before[key & _mask(d - 1)] for key in keys]
            longest = [columns[key >> (8 * (d - 1))] for key in keys]
            steps[d - 1][suffixes, longest] = np.arange(first - len(keys), first)
            below = below[suffixes]
        back = BACK * np.maximum(1, (counts > 0).sum(axis=1, keepdims=True))
        below = (counts + back * below) / (counts.sum(axis=1, keepdims=True) + back)
        states.append(np.log(below).astype(np.float32))
        before = place
    return Tree(contexts, np.concatenate(states), columns, np.concatenate(steps))


def spellings(texts: list[list[bytes]], tree: Tree) -> np.ndarray:
    """The natural logarithm of the probability of every word's spelling and of what ends it.

    The words of all texts follow each other; a text without words counts as one empty word.
    """
    return run_spellings(run_of([b" ".join(words) for words in texts]), Walk(tree))


class Walk:
    """The states of a tree in the order in which places of a text go through them, for all places at once.

    From a state the next byte before a place leads to the state with that byte, or for good to the state's double.
    Both are numbered by where their rows begin.
    """

    def __init__(self, tree: Tree):
        number, self.width = tree.steps.shape
        self.doubles, self.columns, self.logs = number * self.width, tree.columns, tree.states.ravel()
        stay = np.arange(number, 2 * number, dtype=np.int32)[:, None]
        steps = np.concatenate([np.where(tree.steps < 0, stay, tree.steps), np.broadcast_to(stay, tree.steps.shape)])
        self.steps = (steps * np.int32(self.width)).ravel()
        # The first two steps as one, from no byte.
        self.two = self.steps[(self.steps[: self.width, None] + np.arange(self.width)).ravel()]


def run_spellings(run: Run, walk: Walk) -> np.ndarray:
    """:func:`spellings` of a run."""
    column = walk.columns[run.data]

    def before(d: int) -> np.ndarray:
        return column[DEPTH - d : len(column) - d]

    # Suffixes of kept contexts are kept, so the longest kept one is reached byte by byte.
    state = walk.two.take(before(1) * walk.width + before(2))
    for d in range(3, DEPTH + 1):
        state = walk.steps.take(state + before(d))
    state[state >= walk.doubles] -= walk.doubles
    counted = run.counted[DEPTH:]
    logs = walk.logs.take((state + before(0))[counted]).astype(np.float64)
    sizes = run.ends - run.firsts + 1
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


def frequent_words(rows: DataFrame, most: int = FREQUENT) -> DataFrame:
    """``word`` (64-bit hash): the commonest words of the texts of a hash sample. Only a choice of what to broadcast."""

    def count(batches):
        for _, texts in text_batches(batches, max_bytes=4 * RUN_BYTES):
            for run in _runs(texts, 4 * RUN_BYTES):
                keys, counts = np.unique(_numbers(run), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], ["word", "n"])

    # By id and text, so that of a text with very many copies some are in the sample.
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    counted = sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.orderBy(F.col("n").desc(), "word").limit(most).select("word")


def scores(df: DataFrame, learn, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``df``.

    ``learn`` is a condition on the rows: those are learnt from, all others (a null condition too) are held
    out. A null text counts as the empty text, which is one end. Copies count as often as they occur. With
    nothing to learn from, the model is even and no token is known. Further columns are not read; an empty
    table gives an empty result. Rows are kept apart by a number of their own, so ids may be null or repeated.
    """
    spark = df.sparkSession
    learnt = F.coalesce(learn, F.lit(False))
    rows = df.select(df[id_column].alias("doc_id"), (~learnt).alias("held_out"), whole_text(df, text).alias("text"))
    training = rows.where(~F.col("held_out"))
    frequent = np.sort(np.array([x.word for x in frequent_words(training).toLocalIterator()], dtype=np.int64).astype(np.uint64))

    counts = settle(corpus_counts(training, frequent), "counts")
    totals = {x.key: x.n for x in counts.where(F.col("kind") == TEXTS).collect()}
    train_words, train_texts = totals.get(0, 0), totals.get(1, 0)
    train_tokens = train_words + train_texts
    often = counts.where(F.col("kind") == WORDS).select("key", "n").toPandas()  # FREQUENT rows at most
    tree = fit(counts.where(F.col("kind") == BYTES).select(F.col("key").alias("code"), "n"))
    known = dict(zip(often["key"].to_numpy(dtype=np.int64).astype(np.uint64).tolist(), often["n"].tolist()))
    often_counts = np.array([known.get(x, 0) for x in frequent.tolist()], dtype=np.int64)
    sent = share(spark, (tree, Hashed(frequent, np.arange(len(frequent))), often_counts))
    words_share = 1 / max(1, train_words)
    # How likely a word is a text's last.
    last_word = min(0.5, max(train_texts, 1) / max(train_words, 1))

    def score(batches):
        tree, place, counts = shared(sent)
        walk = Walk(tree)
        shares = np.append(counts, 0) * (TRUST * words_share)
        logs, known = np.log10(np.append(counts, 0) + 1.0), np.append(counts > 0, False)
        for part, texts in text_batches(batches, max_bytes=RUN_BYTES):
            run = run_of([value.encode() for value in texts])
            sizes, ids = run.sizes, _numbers(run)
            found = place(ids)  # -1, the last place, for words that are not frequent
            text_of = np.repeat(np.arange(len(texts)), sizes)
            rare = found < 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(text_of[rare], minlength=len(texts)))]).astype(np.int32)
            # One symbol for each word, and one for a text without words.
            symbols = run.symbols
            symbol_text = np.repeat(np.arange(len(texts)), symbols)
            ending = np.full(len(symbol_text), np.log(1 - last_word))
            ending[np.cumsum(symbols) - 1] = np.log(last_word)
            spelt = run_spellings(run, walk) + np.log(1 - TRUST) - ending
            word_share = np.zeros(len(symbol_text))
            word_share[sizes[symbol_text] > 0] = shares[found]
            mixed = spelt.copy()
            mixed[word_share > 0] = np.logaddexp(spelt[word_share > 0], np.log(word_share[word_share > 0]))
            # Rare words get their shares later.
            later = np.zeros(len(symbol_text), dtype=bool)
            later[sizes[symbol_text] > 0] = rare
            mixed[later] = 0
            spelt_later = pa.array(spelt[later].astype(np.float32))
            symbol_ids = np.zeros(len(symbol_text), dtype=np.uint64)
            symbol_ids[sizes[symbol_text] > 0] = ids
            phrases, firsts, phrase_of = phrases_of(symbol_ids, symbols)
            # Phrases are numbered within their text.
            per_text = np.bincount(symbol_text[firsts], minlength=len(texts))
            phrase_ends = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
            at = (phrase_of - phrase_ends[symbol_text])[later].astype(np.int32)
            phrase_logs = np.add.reduceat(mixed + ending, firsts)
            columns = [
                part.column(0),
                part.column(1),
                pa.array((sizes + 1).astype(np.int64)),
                pa.array(np.bincount(text_of, weights=known[found], minlength=len(texts)).astype(np.int64)),
                pa.array(np.bincount(text_of, weights=logs[found], minlength=len(texts)).astype(np.float64)),
                pa.ListArray.from_arrays(pa.array(phrase_ends), pa.array(phrases.astype(np.int64))),
                pa.ListArray.from_arrays(pa.array(phrase_ends), pa.array(phrase_logs.astype(np.float32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[rare].astype(np.int64))),
                pa.ListArray.from_arrays(pa.array(ends), spelt_later),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(at)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "held_out", "n_tokens", "often_known", "often_logs", "phrases", "logs", "rare", "spelt", "at"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        score,
        f"doc_id {kind}, held_out boolean, n_tokens long, often_known long, often_logs double, phrases array<long>, "
        "logs array<float>, rare array<long>, spelt array<float>, at array<int>",
    )
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored", pack=True, hashes=True)

    # The counts of the other words go to where they occur: one shuffle by word, which frequent words stay out of.
    words = counts.where(F.col("kind") == RARE).select(F.col("key").alias("word"), F.col("n").alias("c"))
    single = scored.select("row", F.explode(F.arrays_zip("rare", "spelt", "at")).alias("x"))
    single = single.select("row", F.col("x.rare").alias("word"), F.col("x.spelt").alias("spelt"), F.col("x.at").alias("at"))
    single = single.join(words.hint("shuffle_hash"), "word", "left")
    spelt = F.col("spelt").cast("double")
    mixed = F.when(F.col("c") > 0, F.log(F.exp(spelt) + F.col("c") * (TRUST * words_share))).otherwise(spelt)
    # Dealt out before they are listed: a word's task has hardly two rows of one text to put together.
    single = single.select("row", "at", F.coalesce("c", F.lit(0)).alias("c"), mixed.cast("float").alias("log"))
    per_row = single.repartition("row").groupBy("row").agg(
        F.sum((F.col("c") > 0).cast("int")).alias("rare_known"),
        F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"),
        F.collect_list(F.struct("at", "log")).alias("later"),
    )
    whole = scored.drop("rare", "spelt", "at").join(per_row.hint("shuffle_hash"), "row", "left")
    whole = settle(whole.withColumns({"ats": F.col("later.at"), "later": F.col("later.log")}), "whole", pack=True, hashes=True)
    discard(scored)
    distinct = words.count() + int((often_counts > 0).sum()) + (train_texts > 0)
    log_all = math.log10(train_tokens + distinct + 1)
    zero = F.lit(0).cast("long")
    found = phrase_scores(whole.select("row", "held_out", "phrases", "logs", "ats", "later"), train_texts)
    return whole.join(found.hint("shuffle_hash"), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("often_known") + F.coalesce("rare_known", zero) + int(train_texts > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (
            F.col("often_logs") + F.coalesce("rare_logs", F.lit(0.0)) + math.log10(train_texts + 1) - F.col("n_tokens") * log_all
        ).alias("base_score"),
        (F.col("log_score") / math.log(10)).alias("score"),
    )


def phrases_of(ids: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of texts whose words ``ids`` follow each other, ``symbols`` of them a text: their 64-bit numbers, the
    places of their first words, and for each word the number of its phrase. A text's last phrase has a mark of its end."""
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(symbols) - 1] = True
    cut = last | (ids % np.uint64(ANCHOR) == 0)
    firsts = np.concatenate([[0], np.flatnonzero(cut)[:-1] + 1])
    phrase_of = np.cumsum(np.concatenate([[False], cut[:-1]]))
    place = np.arange(len(ids), dtype=np.uint64) - firsts[phrase_of].astype(np.uint64)
    with np.errstate(over="ignore"):
        # The sum of hashes of words with their places.
        numbers = np.add.reduceat(mix64(mix64(ids) + (place + np.uint64(1)) * _ODD), firsts)
        return mix64(numbers + last[np.flatnonzero(cut)].astype(np.uint64)), firsts, phrase_of


def _then(context: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """The context that a context becomes with a further phrase."""
    with np.errstate(over="ignore"):
        return mix64(mix64(context + np.uint64(1)) * _ODD + phrase)


def contexts_of(phrases: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each phrase of texts that follow each other (``starts`` are the first ones), the contexts of 0, 1, ... phrases
    before it. The start of a text is a phrase before the first; longer contexts that reach beyond it are 0."""
    out = [np.zeros(len(phrases), dtype=np.uint64)]
    for size in range(1, PHRASES + 1):
        longer = np.zeros(len(phrases), dtype=np.uint64)
        longer[1:] = _then(out[-1], phrases)[:-1]
        longer[starts] = START if size == 1 else 0
        if size > 1:
            longer[out[-1] == 0] = 0
        out.append(longer)
    return out


START = np.uint64(0x5DEECE66D)


def _phrases(batches):
    """For rows ``row, held_out, phrases, logs, ats, later``: the batch, the phrases, where each row's begin, and their spellings."""
    for batch in (whole.slice(start, RUN_ROWS) for whole in batches for start in range(0, whole.num_rows, RUN_ROWS)):
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        lists = columns["phrases"]
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        phrases = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        logs = columns["logs"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        # Rare words add their share to the phrase they stand in; rows without any have a null there.
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(columns["ats"]), 0), dtype=np.int64)
        into = np.repeat(offsets[:-1], lengths) + columns["ats"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        logs += np.bincount(into, weights=columns["later"].flatten().to_numpy(zero_copy_only=False), minlength=len(logs))[: len(logs)]
        yield columns, phrases, offsets, logs


def _alive(phrases: np.ndarray, starts: np.ndarray, bits: np.ndarray | None) -> np.ndarray:
    """Which phrases a phrase that training has met twice may concern: it is one, stands behind one, or begins a text.
    Without a filter, all."""
    if bits is None:
        return np.ones(len(phrases), dtype=bool)
    alive = _passes(_then(np.zeros(len(phrases), dtype=np.uint64), phrases), bits)
    alive[1:] |= alive[:-1].copy()
    alive[starts] = True
    return alive


def _learnt(batches):
    """``key``: the phrases of the rows that are learnt from, ``y0`` of :func:`_events`."""
    for batch in batches:
        lists = batch.column(1).filter(pa.compute.invert(batch.column(0)))
        phrases = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for start in range(0, len(phrases), 1 << 16):
            keys = _then(np.zeros(len(phrases[start : start + (1 << 16)]), dtype=np.uint64), phrases[start : start + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], ["key"])


def _spelt(batches, bits: np.ndarray, novel: float):
    """``row, spelt``: the sum over the phrases of a row that the filter ``bits`` leaves out, each as ``novel`` and its spelling."""
    for columns, phrases, offsets, logs in _phrases(batches):
        rest = np.where(_alive(phrases, offsets[:-1], bits), 0.0, logs + novel)
        rest = np.bincount(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), weights=rest, minlength=len(offsets) - 1)
        yield pa.RecordBatch.from_arrays([columns["row"], pa.array(rest)], ["row", "spelt"])


def _events(batches, bits: np.ndarray | None):
    """The phrases of rows ``row, held_out, phrases, logs, ats, later``; those that the filter ``bits`` lets pass, if given.

    ``x1, x2, ...`` are the contexts before a phrase, ``y0, y1, ...`` the contexts followed by it, ``log`` its spelling.
    """
    for columns, phrases, offsets, logs in _phrases(batches):
        sizes = np.diff(offsets)
        contexts = contexts_of(phrases, offsets[:-1])
        seen = [_then(context, phrases) for context in contexts]
        for y, context in zip(seen[1:], contexts[1:]):
            y[context == 0] = 0
        rows = np.repeat(columns["row"].to_numpy(zero_copy_only=False), sizes)
        own = np.repeat(~np.asarray(columns["held_out"].to_numpy(zero_copy_only=False), dtype=bool), sizes)
        alive = _alive(phrases, offsets[:-1], bits)
        # What has no such context gets a key that nothing else has, so that no task gets all of it.
        alone = mix64((rows.astype(np.uint64) << np.uint64(20)) + np.arange(len(rows), dtype=np.uint64) + START)
        for keys in (*contexts[1:], *seen[1:]):
            np.copyto(keys, alone, where=keys == 0)
        out = {"row": pa.array(rows[alive]), "own": pa.array(own[alive]), "log": pa.array(logs[alive])}
        out |= {f"x{k}": pa.array(contexts[k][alive].astype(np.int64)) for k in range(1, PHRASES + 1)}
        out |= {f"y{k}": pa.array(seen[k][alive].astype(np.int64)) for k in range(PHRASES + 1)}
        yield pa.RecordBatch.from_pydict(out)


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = keys % np.uint64(FILTER_BITS)
    return ((bits[(place // np.uint64(64)).astype(np.int64)] >> (place % np.uint64(64))) & np.uint64(1)).astype(bool)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits in which the places of all keys (``key``) are set."""
    # The low bits of a number are the same with and without a sign.
    place = F.col("key").bitwiseAND(FILTER_BITS - 1)
    parts = keys.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast((key & {FILTER_BITS - 1}) % 64 as int))").alias("bit"))
    known = parts.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[known["at"].to_numpy(dtype=np.int64)] = known["bits"].to_numpy(dtype=np.int64).astype(np.uint64)
    return bits


def phrase_scores(rows: DataFrame, train_texts: int) -> DataFrame:
    """``row, log_score`` (natural logarithm) of rows ``row, held_out, phrases, logs, ats, later``."""
    fields = ["row long", "own boolean", "log double"]
    fields += [f"x{k} long" for k in range(1, PHRASES + 1)] + [f"y{k} long" for k in range(PHRASES + 1)]
    schema = ", ".join(fields)
    # Of all phrases only the counts are needed, and the sum of their spellings for each row.
    counts = rows.select("held_out", "phrases").mapInArrow(_learnt, "key long").groupBy("key").agg(F.count("*").alias("c"))
    counts = settle(counts.groupBy((F.col("c") > 1).alias("kept"), F.when(F.col("c") > 1, F.col("key")).alias("key")).agg(F.sum("c").alias("c")), "phrases")
    total, kept_total = counts.agg(F.sum("c"), F.sum(F.when(F.col("kept"), F.col("c")))).first()
    total, kept_total = total or 0, kept_total or 0
    kept = counts.where("kept").select("key", "c")
    novel = math.log((total - kept_total + 1) / (total + 1))
    sent = share(rows.sparkSession, _filter_of(kept))
    spelt = rows.mapInArrow(lambda batches: _spelt(batches, shared(sent), novel), "row long, spelt double")
    alive = rows.mapInArrow(lambda batches: _events(batches, shared(sent)), schema)

    def mixed(count, weight, log, size):
        """The logarithm of (count + weight * e ** log) / size."""
        return F.when(count > 0, F.log(count + weight * F.exp(log))).otherwise(F.log(weight) + log) - F.log(size)

    number = F.coalesce("c", F.lit(0))
    lit = lambda x: F.lit(float(x))
    states = alive.join(kept.withColumnRenamed("key", "y0").hint("shuffle_hash"), "y0", "left")
    states = states.withColumns({"c": number, "p": mixed(number, lit(total - kept_total + 1), F.col("log"), lit(total + 1))})
    states = states.drop("y0", "log").withColumn("open", F.lit(True))
    start = rows.sparkSession.createDataFrame([(int(START.astype(np.int64)), train_texts)], "key long, c long")
    # How often each context of one phrase more has been met: as often as its last phrase in the context before.
    met, before, done = kept.unionByName(start), None, []
    for k in range(1, PHRASES + 1):
        settled = settle(states, "states", pack=True, hashes=True)
        if k == 2:
            discard(before)  # of the table before, all rows are in the one just written
        # A phrase whose context is not kept has its probability: no longer context of it is kept either.
        before, states = settled, settled.where("open")
        if k > 1:
            done.append(settled.where("NOT open").select("row", "p"))
        pairs = states.where("own AND c > 1").groupBy(F.col(f"y{k}").alias("key"))
        pairs = pairs.agg(F.count("*").alias("c"), F.max(f"x{k}").alias("context"), F.max("p").alias("p")).where("c > 1")
        pairs = settle(pairs, "pairs")
        sums = pairs.groupBy("context").agg(F.sum("c").alias("kept")).join(met.select(F.col("key").alias("context"), F.col("c").alias("met")), "context")
        gain = mixed(F.col("c"), F.col("met") - F.col("kept") + 1.0, F.col("p"), F.col("met") + 1.0) - F.col("p")
        gains = pairs.join(sums.hint("shuffle_hash"), "context").groupBy("context", "kept", "met").agg(F.sum(F.col("c") * gain).alias("gain"))
        contexts = settle(gains.where(F.col("gain") >= LEAST_GAIN).drop("gain"), "contexts")
        found = states.drop("c", "open").join(contexts.withColumnRenamed("context", f"x{k}").hint("shuffle_hash"), f"x{k}", "left")
        found = found.join(pairs.select(F.col("key").alias(f"y{k}"), "c").hint("shuffle_hash"), f"y{k}", "left")
        p = F.when(F.col("met").isNull(), F.col("p")).otherwise(
            mixed(number, F.col("met") - F.col("kept") + 1.0, F.col("p"), F.col("met") + 1.0)
        )
        # What this state has used is not carried on.
        states = found.withColumns({"p": p, "c": F.when(F.col("met").isNotNull(), number).otherwise(0), "open": F.col("met").isNotNull()}).drop("met", "kept", f"x{k}", f"y{k}")
        met = pairs.select("key", "c")
    ended = states.select("row", "p")
    for part in done:
        ended = ended.union(part)
    told = ended.groupBy("row").agg(F.sum("p").alias("told"))
    out = spelt.join(told.hint("shuffle_hash"), "row", "left")
    return out.select("row", (F.col("spelt") + F.coalesce("told", F.lit(0.0))).alias("log_score"))


def corpus_scores(df: DataFrame) -> DataFrame:
    """Scores of ``documents``; every seventh text, by a checksum of its id, is held out."""
    return scores(df, crc_remainder(df["doc_id"], 7) != 2)
