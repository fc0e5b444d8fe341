"""Token counts of a piece vocabulary by heap-and-linked-list merging (operator 5).

The vocabulary is a SentencePiece byte-pair model: a text gets a word mark in front, spaces become
word marks, and of all adjacent symbols the pair with the best score (the leftmost of equals) is
merged until none is left. A symbol outside the vocabulary stands for its UTF-8 bytes. So

    count = symbols at the start - merges + further bytes of symbols outside the vocabulary

and no piece identifiers are made. If no piece has a word mark after another character, merges never
cross from a character to a word mark, and a text falls into segments which are counted one by one. The
same holds between any two characters that no piece has side by side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataproof.llm.common import share, shared, text_batches, whole_text

MARK = "▁"
NORMAL, UNUSED, USER_DEFINED = 1, 5, 4  # piece types of the model format
CACHE = 1 << 19


@dataclass
class PieceVocabulary:
    """Ranks of the pieces that merging may make; the lower the rank, the earlier the merge."""

    ranks: dict[str, int]
    mark_first: bool
    splits: bool = field(init=False)
    inside: set[tuple[str, str]] = field(init=False)

    def __post_init__(self):
        self.inside = {pair for piece in self.ranks for pair in zip(piece, piece[1:])}
        self.splits = all(MARK not in piece.lstrip(MARK) for piece in self.ranks)


def read_pieces(path: str) -> PieceVocabulary:
    """The pieces of a SentencePiece byte-pair model. Models with another way of normalising are an error."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = model.normalizer_spec
    plain = spec.name == "identity" and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    plain = plain and not spec.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
    kinds = {piece.type for piece in model.pieces}
    if model.trainer_spec.model_type != 2 or not plain or kinds & {UNUSED, USER_DEFINED}:
        raise ValueError("only byte-pair models with the identity normaliser are supported")
    if not model.trainer_spec.byte_fallback:
        raise ValueError("only models with byte fallback are supported")
    return _ranked({p.piece: p.score for p in model.pieces if p.type == NORMAL}, spec.add_dummy_prefix)


def _ranked(scores: dict[str, float], mark_first: bool) -> PieceVocabulary:
    """Best score first; pieces of one score share a rank, so that the leftmost pair wins among them."""
    order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    return PieceVocabulary({piece: order[score] for piece, score in scores.items()}, mark_first)


def count_segment(segment: str, ranks: dict[str, int]) -> int:
    """Tokens of one segment.

    ``after`` and ``before`` link the symbols that are left; ``wanted[i]`` is the rank of the pair that
    begins at symbol ``i``. A heap entry holds a rank and a place, and is stale if that rank is no longer
    the wanted one.
    """
    parts = list(segment)
    size = len(parts)
    get = ranks.get
    wanted = [get(a + b, -1) for a, b in zip(parts, parts[1:])]
    wanted.append(-1)
    heap = [rank * size + i for i, rank in enumerate(wanted) if rank >= 0]
    merges = 0
    if heap:
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            rank, i = divmod(heappop(heap), size)
            if wanted[i] != rank:
                continue
            merges += 1
            j = after[i]
            part = parts[i] = parts[i] + parts[j]
            wanted[j] = -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                wanted[i] = rank = get(part + parts[k], -1)
                if rank >= 0:
                    heappush(heap, rank * size + i)
            else:
                wanted[i] = -1
            h = before[i]
            if h >= 0:
                wanted[h] = rank = get(parts[h] + part, -1)
                if rank >= 0:
                    heappush(heap, rank * size + h)
    for symbol in segment:
        if symbol not in ranks:
            size += len(symbol.encode()) - 1
    return size - merges


class SegmentCounts(dict):
    """Counts of segments seen before, by ``front + segment``; emptied when it grows too large."""

    def __init__(self, vocabulary: PieceVocabulary, front: str, limit: int = CACHE):
        super().__init__()
        self.ranks, self.inside, self.front, self.limit = vocabulary.ranks, vocabulary.inside, front, limit
        self.parts: dict[str, int] = {}

    def __missing__(self, segment: str) -> int:
        whole = self.front + segment
        # No piece has these two characters side by side: no merge crosses here.
        cuts = [i for i, pair in enumerate(zip(whole, whole[1:]), 1) if pair not in self.inside]
        count = 0
        for start, end in zip([0, *cuts], [*cuts, len(whole)]):
            part = whole[start:end]
            number = self.parts.get(part)
            if number is None:
                number = count_segment(part, self.ranks)
                if len(part) <= 64:
                    if len(self.parts) >= self.limit:
                        self.parts.clear()
                    self.parts[part] = number
            count += number
        if len(segment) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[segment] = count
        return count


def text_counter(vocabulary: PieceVocabulary):
    """A function from a text to its number of tokens."""
    marked = SegmentCounts(vocabulary, MARK)
    plain = SegmentCounts(vocabulary, "")
    segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def count(text: str) -> int:
        if not text:
            return 0
        if vocabulary.mark_first and vocabulary.splits and text[0] != " " and "  " not in text and MARK not in text:
            return sum(map(marked.__getitem__, text.split(" ")))
        text = (MARK + text if vocabulary.mark_first else text).replace(" ", MARK)
        return sum(map(plain.__getitem__, segments(text) if vocabulary.splits else [text]))

    return count


def token_counts(df: DataFrame, vocabulary: PieceVocabulary, id_column: str = "doc_id", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``df``.

    A null text counts as the empty text, which has no tokens; repeated rows and null ids are counted
    row by row; further columns of ``df`` are not read; an empty table gives an empty result. A text is
    cut into segments, never shortened: memory is one text and the counts of recent segments.
    """
    sent = share(df.sparkSession, vocabulary)

    def count(batches):
        counter = text_counter(shared(sent))
        for part, texts in text_batches(batches):
            tokens = pa.array([counter(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tokens], ["doc_id", "n_bytes", "n_tokens"])

    text = whole_text(df)
    rows = df.select(
        df[id_column].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
