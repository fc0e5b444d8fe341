"""Token counts and byte-level encoding against the public libraries."""

from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from dataproof.llm import byte_bpe, piece_counts

ODD = ["", " ", "  a  b ", "▁x ▁", "<s>hi</s><0x41>", "ﬁ①é é\xa0x　y\x00z", "a" * 700, "ab" * 600 + "!!!!" * 200,
       " " * 500, "'s 't x're", "🙂" * 90, "a\tb\n c", "x" * 5000]


def texts_of(documents):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab  ▁e\ńé中<s>0!") for _ in range(60)) for _ in range(500)]
    return [row.text for row in documents.select("text").collect()] + ODD + mixed


@pytest.fixture(scope="module")
def pieces():
    return piece_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = {token: i for i, token in enumerate(vocabulary.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_piece_counts_match_the_library(documents, pieces):
    texts = texts_of(documents)
    count = piece_counts.text_counter(pieces)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [count(text) for text in texts] == [len(ids) for ids in library.encode(texts)]


def test_piece_counts_without_segments(pieces):
    """A vocabulary whose pieces go on after a word mark is counted over whole texts."""
    crossing = piece_counts.PieceVocabulary({**pieces.ranks, "a▁b": -1}, True)
    assert not crossing.splits
    assert piece_counts.text_counter(crossing)("a b") == 2  # "▁" and "a▁b"


def test_encoder_matches_the_library(documents, vocabulary, library):
    texts = texts_of(documents)
    encoder = byte_bpe.Encoder(vocabulary)
    found = encoder.encode_many(texts)
    assert found == [library.encode_ordinary(text) for text in texts]
    assert [encoder.decode(ids) for ids in found] == [text.encode() for text in texts]


def test_long_pieces_merge_as_matrices_do(vocabulary, monkeypatch):
    encoder = byte_bpe.Encoder(vocabulary)
    piece = ("abracadabra" * 20).encode()
    row = encoder.first[list(piece)][None, :]
    assert encoder.merge_matrix(row)[0] == encoder.merge_long(piece)


def test_odd_rows(odd_documents, pieces, vocabulary, library):
    rows = {(r.doc_id, r.n_bytes): r for r in piece_counts.token_counts(odd_documents, pieces).collect()}
    assert rows[2, 0].n_tokens == 0 and rows[4, max(k[1] for k in rows)].over_limit
    assert piece_counts.token_counts(odd_documents, pieces).count() == 12
    got = byte_bpe.round_trip(odd_documents, vocabulary).collect()
    texts = [r.text or "" for r in odd_documents.collect()]
    ids = [library.encode_ordinary(text) for text in texts]
    expected = [
        (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        for x, text in zip(ids, texts)
    ]
    assert sorted(tuple(r)[1:] for r in got) == sorted(expected)
    assert all(r.restored for r in byte_bpe.encode_checked(odd_documents, vocabulary).collect())
    encoded = byte_bpe.encode(odd_documents, vocabulary)
    decoded = byte_bpe.decode(encoded, vocabulary).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted(text.encode() for text in texts)


def test_empty_table(odd_documents, pieces, vocabulary):
    empty = odd_documents.where("false")
    assert piece_counts.token_counts(empty, pieces).count() == 0
    assert byte_bpe.round_trip(empty, vocabulary).count() == 0


def test_ranks_are_checked(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path), ".")
