"""Encoding against the tokenizer library on whole texts, and round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pactlens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.ForcedBoundaryEncoder(PATH)
ODD = [
    "", " ", "  x", "a  b", "\n\n\nfoo", "x \n", "+'s", "it's 'll we'RE", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>  c", "<|endof", "<<|endoftext|>>",
    "é è  é é　x y\u0085z", "qz zq jx Qx xQ", "12a3 4 ५६", "日本語、テスト。 ", "🙂🙃 a🙂'd", "\x00\x1c \x1f﻿", "'" * 9, " '" * 9, "x" * 70_000,
]
PARTS = ["a", "Qz", " ", "  ", "\n", "\t", "'", "'s", "'re", "é", "ß", "日", " ", " ", "　", "1", "२", ".", "+", "<|endoftext|>", "<|", "|>", "🙂", "́", "\x00", "\x1c", "​"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def our_ids(texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in OURS.encode_all(t.encode() for t in texts)]


def test_odd_texts_and_corpus(corpus):
    texts = ODD + [text for _, text in corpus]
    assert our_ids(texts) == [library_ids(t) for t in texts]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=3)), max_size=14).map("".join))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = library_ids(text)
    assert our_ids([text]) == [ids]
    assert OURS.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_decoding_of_any_ids():
    draw = np.random.default_rng(3)
    for _ in range(200):
        ids = draw.integers(0, len(OURS.tokens), 12)
        assert OURS.decode(ids.astype("<u4").tobytes()) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_queries_columns(make_documents, corpus):
    rows = corpus[:40] + [(900, None), (901, ""), (902, "a<|endoftext|>"), (902, "a<|endoftext|>"), (None, "x")]
    documents = make_documents(rows, ids=1, n_tokens="x")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in rows:
        ids = library_ids(text or "")
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    got = [tuple(r) for r in bpe.round_trip_digests(documents, PATH).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    texts = [(r.doc_id, r.text) for r in bpe.decode(bpe.encode(documents, PATH), PATH).collect()]
    assert sorted(map(str, texts)) == sorted(str((d, t or "")) for d, t in rows)
    assert bpe.round_trip_digests(make_documents([]), PATH).count() == 0


@pytest.mark.parametrize("text", ["the quick brown fox", "words, and more words"])
def test_cuts_before_blanks(text):
    assert len(OURS.fragments(text.encode())) >= 4
