"""Byte-level byte-pair encoding and decoding with padded matrices (operator 7).

A text is cut by the vocabulary's pattern. Pieces that are no token themselves are put into matrices
with one piece a row, pieces of like length together, padded on the right. In each round every row
looks up the ranks of its adjacent pairs in a hashed table, merges its leftmost pair of the lowest rank
and closes the gap; rows without a pair are done.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dataproof.llm.common import Hashed, share, shared, text_batches, whole_text

PAD = -1
NONE = np.int32(2**31 - 1)
#: Widest matrix row. A longer piece would cost the square of its length; it is merged with a heap.
WIDEST = 256
#: Symbols of one matrix.
CELLS = 1 << 20
CACHE = 1 << 19


@dataclass
class ByteVocabulary:
    """Token bytes by id, and the pattern that cuts a text into pieces."""

    tokens: list[bytes]
    pattern: str


def read_ranks(path: str, pattern: str) -> ByteVocabulary:
    """The ranks of a file with one base64 token and its rank a line. Ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens) or len(set(tokens)) != len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError("the ranks need one token each and all single bytes")
    return ByteVocabulary(tokens, pattern)


class Encoder:
    """Encodes and decodes; built once a task."""

    def __init__(self, vocabulary: ByteVocabulary):
        import regex

        self.tokens = vocabulary.tokens
        self.ids = {token: i for i, token in enumerate(self.tokens)}
        self.find = regex.compile(vocabulary.pattern).findall
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        get = self.ids.get
        for i, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                a = get(token[:cut])
                if a is not None and (b := get(token[cut:])) is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self.pairs = Hashed(keys, np.array(made, dtype=np.int32), missing=int(NONE))
        self.digits = [str(i) for i in range(len(self.tokens))]
        # Tuples of integers are no work for the garbage collector, lists are.
        self.cache: dict[str, tuple[int, ...]] = {}

    def ranks(self, rows: np.ndarray) -> np.ndarray:
        """The ranks of adjacent pairs; pairs with padding have none."""
        left, right = rows[:, :-1], rows[:, 1:]
        out = np.full(left.shape, NONE, dtype=np.int32)
        real = right != PAD
        out[real] = self.pairs((left[real].astype(np.uint64) << np.uint64(32)) | right[real].astype(np.uint64))
        return out

    def merge_matrix(self, rows: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of every row."""
        done: list[tuple[int, ...]] = [()] * len(rows)
        number = np.arange(len(rows))
        ranks = self.ranks(rows)
        while len(rows):
            lowest = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            every = np.arange(len(rows))
            best = ranks[every, lowest] if ranks.shape[1] else np.full(len(rows), NONE)
            if (over := best == NONE).any():
                ended = rows[over]
                real = ended != PAD
                flat, stops = ended[real].tolist(), np.cumsum(real.sum(axis=1)).tolist()
                for i, start, stop in zip(number[over].tolist(), [0, *stops], stops):
                    done[i] = tuple(flat[start:stop])
                on = ~over
                rows, ranks, lowest, best, number = rows[on], ranks[on], lowest[on], best[on], number[on]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            rows[every, lowest] = best
            # Close the gap: what stands right of the merged pair moves one place to the left.
            place = np.arange(rows.shape[1] - 1)[None, :]
            rows = np.take_along_axis(rows, place + (place > lowest[:, None]), axis=1)
            if rows.shape[1] == 1:
                ranks = ranks[:, :0]
                continue
            place = np.arange(rows.shape[1] - 1)[None, :]
            ranks = np.take_along_axis(ranks, place + (place > lowest[:, None]), axis=1)
            # Only the pairs at the merged symbol are new.
            for at in (lowest - 1, lowest):
                ok = np.flatnonzero((at >= 0) & (at < rows.shape[1] - 1))
                at = at[ok]
                ranks[ok, at] = self.ranks(np.stack([rows[ok, at], rows[ok, at + 1]], axis=1))[:, 0]
        return done

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one long piece: the same merges in the same order, taken from a heap."""
        tokens, get = self.tokens, self.ids.get
        parts = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            made = get(tokens[parts[i]] + tokens[parts[j]])
            if made is not None:
                heapq.heappush(heap, (made, i, parts[i], parts[j]))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            made, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= size or parts[j] != right:
                continue
            parts[i], parts[j] = made, PAD
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return tuple(p for p in parts if p != PAD)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of ``pieces`` into the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ids.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > WIDEST:
                self.cache[piece] = self.merge_long(raw)
            else:
                by_width.setdefault((len(raw) + 3) // 4 * 4, []).append((piece, raw))
        for width, found in by_width.items():
            step = max(1, CELLS // width)
            for start in range(0, len(found), step):
                some = found[start : start + step]
                rows = np.full((len(some), width), PAD, dtype=np.int32)
                sizes = np.array([len(raw) for _, raw in some])
                flat = np.frombuffer(b"".join(raw for _, raw in some), dtype=np.uint8)
                rows[np.arange(width)[None, :] < sizes[:, None]] = self.first[flat]
                for (piece, _), ids in zip(some, self.merge_matrix(rows)):
                    self.cache[piece] = ids

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(text) for text in texts]
        new = {piece for pieces in cut for piece in pieces}
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
        self.learn({piece for piece in new if piece not in self.cache})
        known = self.cache.__getitem__
        return [[i for ids in map(known, pieces) for i in ids] for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _mapped(df: DataFrame, vocabulary: ByteVocabulary, id_column: str, fields: list[tuple[str, pa.DataType, str]], make):
    """One row per row of ``df``: the id and the columns that ``make(encoder, text, ids)`` gives."""
    sent = share(df.sparkSession, vocabulary)

    def run(batches):
        encoder = Encoder(shared(sent))
        for part, texts in text_batches(batches, max_bytes=4 << 20):
            made = [make(encoder, text, ids) for text, ids in zip(texts, encoder.encode_many(texts))]
            columns = zip(fields, zip(*made))
            arrays = [part.column(0), *(pa.array(values, kind) for (_, kind, _), values in columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(name for name, _, _ in fields)])

    rows = df.select(df[id_column].alias("doc_id"), whole_text(df).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{name} {sql}" for name, _, sql in fields)]))


def encode(df: DataFrame, vocabulary: ByteVocabulary, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` (array of token ids) of every row of ``df``.

    A null text counts as the empty text, which has no tokens; repeated rows are encoded row by row;
    further columns are not read; an empty table gives an empty result.
    """
    fields = [("ids", pa.list_(pa.int32()), "array<int>")]
    return _mapped(df, vocabulary, id_column, fields, lambda encoder, text, ids: (ids,))


def decode(df: DataFrame, vocabulary: ByteVocabulary, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, decoded`` (binary) of every row of ``df``; null ids decode to no bytes."""
    sent = share(df.sparkSession, vocabulary.tokens)

    def run(batches):
        tokens = shared(sent)
        for batch in batches:
            made = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "decoded"])

    rows = df.select(df[id_column].alias("doc_id"), df[ids_column].alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, decoded binary")


def _digest(encoder: Encoder, text: str, ids: list[int]) -> tuple[int, str, str]:
    named = " ".join(map(encoder.digits.__getitem__, ids))
    back = encoder.decode(ids)
    return len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def round_trip(df: DataFrame, vocabulary: ByteVocabulary, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, the ids decoded, both digested."""
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _mapped(df, vocabulary, id_column, fields, _digest)


def encode_checked(df: DataFrame, vocabulary: ByteVocabulary, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, ids, n_tokens, restored``: every text encoded, and whether the decoded ids are the text again."""
    fields = [("ids", pa.list_(pa.int32()), "array<int>"), ("n_tokens", pa.int64(), "long"), ("restored", pa.bool_(), "boolean")]
    return _mapped(
        df, vocabulary, id_column, fields, lambda encoder, text, ids: (ids, len(ids), encoder.decode(ids) == text.encode())
    )
