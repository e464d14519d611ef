"""Byte-level BPE by matrices against the library, row by row, and its inverse."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import piecebatch, queries

PATH, PATTERN = queries.vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = piecebatch.Vocabulary.load(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})
ENCODER = piecebatch.Encoder(VOCABULARY, PATTERN)
R = random.Random(5)
ODD = [
    None, "", " ", " \n\t  ", "a", "x" * 50_000, "ab" * 3000, "é" * 3000, "中文" * 2000, "don't 'S'tX a'b'll", "  x\x85y\x1c z w", "<|endoftext|> a", "same", "same", "= " * 900 + "=" * 5000,
    "".join(R.choice("abcdefgh") for _ in range(5000)), "".join(R.choice(" 'sé中1!\n\U0001f600") for _ in range(5000)), "word " * 3000,
]


def test_equal_to_the_library(spark):
    table = spark.createDataFrame([(i, t, "w", [1]) for i, t in enumerate(ODD)], "doc_id long, text string, key string, ids array<int>").repartition(3)
    got = {r.doc_id: r for r in piecebatch.round_trip(table, PATH, PATTERN).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = LIBRARY.encode_ordinary(text or "")
        raw = LIBRARY.decode_bytes(ids)
        assert raw == (text or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].n_bytes) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), len(raw))
    listed = piecebatch.encode(table, PATH, PATTERN)
    assert {r.doc_id: r.ids for r in listed.collect()} == {i: LIBRARY.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert {r.doc_id: bytes(r.bytes) for r in piecebatch.decode(listed, PATH).collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}


@pytest.mark.parametrize("longest", [4, 16])
def test_matrix_and_heap_merge_alike(monkeypatch, longest):
    """Pieces around the longest bucket's edge, by either way."""
    pieces = [*{"".join(R.choice("thean ingé") for _ in range(n)).encode() for n in range(1, 60) for _ in range(30)}]
    want = VOCABULARY.merge(pieces)
    assert want == [VOCABULARY.merge_long(p) for p in pieces]
    monkeypatch.setattr(piecebatch, "LONGEST", longest)
    assert VOCABULARY.merge(pieces) == want


def test_a_tie_goes_to_the_leftmost_pair():
    """Of overlapping pairs of one rank the first merges, and a merge may make a pair of a lower rank than its own."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aba": 256, b"ab": 257, b"aa": 258}
    own = piecebatch.Vocabulary(ranks)
    other = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 9):
        for k in range(2**n):
            text = "".join("ab"[k >> i & 1] for i in range(n))
            want = other.encode_ordinary(text)
            assert own.merge([text.encode()]) == [want] and own.merge_long(text.encode()) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t'stlé中A12!.\x85 \U0001f600"), max_size=80), st.integers(1, 9))
def test_chunks_split_like_the_whole(text, size):
    parts = [*piecebatch.chunks(text, size)]
    assert "".join(parts) == text
    assert [p for part in parts for p in ENCODER.find(part)] == ENCODER.find(text)
    assert [*ENCODER.encode([text])[0]] == LIBRARY.encode_ordinary(text)


def test_what_is_forgotten_does_not_matter(monkeypatch):
    monkeypatch.setattr(piecebatch, "CACHE", 3)
    monkeypatch.setattr(piecebatch, "STRETCH", 20)
    encoder = piecebatch.Encoder(VOCABULARY, PATTERN)
    texts = ["a few words", "", "more words and a few more words", "x" * 200, "words"]
    got = [[] for _ in texts]
    for i, _, ids in encoder.each(texts):
        got[i] += ids
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert piecebatch.round_trip(empty, PATH, PATTERN).count() == 0 and piecebatch.encode(empty, PATH, PATTERN).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op12_piece_matrices"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
