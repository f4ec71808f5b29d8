import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm import bpe

PATH = bpe.tokenizer_path()
TEXTS = [None, "", " ", "a", "<|endoftext|>x  <|endoftext|>", "  \n\n a\t b", "日本語😀 テスト" * 50, "x" * 5000, "\x00\x01 ab", "it's we'll DON'T 12 345 ²½ ", "é" * 100, "   a \u0085b", "ab" * 40 + " " + "0123456789" * 30, "the " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def want(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_equals_the_library(library, encoder):
    for text, raw in zip(TEXTS, encoder.ids_bytes(TEXTS)):
        ids = np.frombuffer(raw, encoder.kind).tolist()
        assert ids == want(library, text)
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(library, encoder, text):
    assert encoder.encode(text) == want(library, text) and encoder.decode(encoder.encode(text)) == text


@given(st.binary(min_size=1, max_size=80))
@settings(max_examples=300, deadline=None)
def test_scalar_and_matrix_trees_agree(encoder, piece):
    width = max(2, 1 << (len(piece) - 1).bit_length())
    got = bpe._merge_rows(encoder.voc, [piece, piece[:1]], width)
    assert np.frombuffer(got[0], encoder.kind).tolist() == bpe.merge_word(encoder.voc, piece)
    assert np.frombuffer(got[1], encoder.kind).tolist() == bpe.merge_word(encoder.voc, piece[:1])


def test_broken_sequences_become_replacement_characters(library, encoder):
    ids = encoder.encode("é")
    first = [i for i in range(256) if encoder.voc.token[i] == b"\xc3"]
    assert encoder.decode(first) == library.decode(first, skip_special_tokens=False) == "�" and encoder.decode(ids) == "é"


def test_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    small = bpe.Encoder(PATH)
    for text in ("one two three four five", "two nine ten eleven"):
        assert small.encode(text) == want(library, text)


def test_frames(spark, library):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(3, "a", "x", 5), (None, "b", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = bpe.round_trip(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            ids = want(library, TEXTS[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
    tokens = bpe.encode(docs)
    assert {(r.doc_id, r.text) for r in bpe.decode(tokens).collect()} == {(i, t or "") for i, t, _, _ in rows}
    assert bpe.round_trip(docs.where("false")).count() == 0


def test_query(spark, sf, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op9_bpe(spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want(library, text[r.doc_id]))).encode()).hexdigest()


def test_keys_of_the_scalar_tree_have_no_limit(monkeypatch, encoder):
    piece = b"international" * 20
    want = bpe.merge_word(encoder.voc, piece)
    # A limit this low stands for a piece of many megabytes.
    monkeypatch.setattr(bpe, "NO_PAIR", np.int64(1) << 10)
    assert bpe.merge_word(encoder.voc, piece) == want and len(want) < len(piece)
