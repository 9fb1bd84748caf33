"""Packing and token files against the tokenizer library used plainly."""

import math
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pactlens.llm import packing, token_files, word_tokens
from pactlens.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "A.B. c., d.", "It's we're I'LL <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "é É É. é, İ ǅ ß",
    "हिन्दी. 中文，字 ١٢ 12a,b.   x\u0085y", "a­b \x1c\x1f. ﻿", "word. \x0bword,\x0cword.\rword", "x" * 30_000, "tail.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_texts_ids(library, corpus):
    texts = [text or "" for text in ODD] + [text for _, text in corpus]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in WordEncoder(PATH).encode_all(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(make_documents, library, corpus):
    rows = corpus + [(1000 + n, text) for n, text in enumerate(ODD)] + [(1000, None), (None, "no id"), (5000, "word " * 5000)]
    capacity = 256
    made = packing.pieces(make_documents(rows, length=3, sequence_id=1), PATH, capacity=capacity, with_ids=True)
    packed = packing.pack(made, capacity, shard_pieces=64).collect()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want.append((doc_id, piece, start, len(part), crc(part), part))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in packed], key=key) == sorted(want, key=key)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * math.ceil(sum(r.length for r in packed) / capacity) + 2


def test_packing_ties_and_empty(make_documents):
    lengths = np.array([156] * 50 + [100] * 50)
    place, offset, gaps = packing.sum_of_squares(lengths, 256)
    assert len(gaps) == 50 and not gaps.any()
    assert packing.pack(packing.pieces(make_documents([]), PATH)).count() == 0
    assert packing.pack(packing.pieces(make_documents([(1, "")]), PATH)).count() == 1


def test_sequences(make_documents):
    packed = packing.pack(packing.pieces(make_documents([(1, "a b"), (2, "c d e")]), PATH, capacity=16, with_ids=True), 16)
    rows = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == 7 and len(rows) == 1


def test_token_files(spark, make_documents, library, corpus, tmp_path):
    rows = corpus + [(1000 + n, text) for n, text in enumerate(ODD)] + [(1000, None), (None, "no id"), (-(2**63), "least id"), (2**63 - 1, "largest")]
    folder = f"file://{tmp_path}/tokens"
    token_files.write(make_documents(rows, start=1, ids="x"), folder, PATH, shard_ids=20_000)
    got = token_files.read(spark, folder, with_ids=True).collect()
    ids = {}
    for doc_id, text in rows:
        ids.setdefault(doc_id, []).append(library.encode(text or "", add_special_tokens=False).ids + [1])
    assert sorted(map(str, [(r.doc_id, r.ids) for r in got])) == sorted(str((d, x)) for d, many in ids.items() for x in many)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_token_files_of_nothing_and_wrong_dictionary(spark, make_documents, tmp_path):
    token_files.write(make_documents([]), f"file://{tmp_path}/none", PATH)
    assert token_files.read(spark, f"file://{tmp_path}/none").count() == 0
    folder = f"file://{tmp_path}/one"
    manifest = token_files.write(make_documents([(1, "one text")]), folder, PATH)
    with pytest.raises(ValueError, match="dictionary"):
        token_files.ShardReader(f"{folder}/shards", manifest.first().file, b"other")


def test_marks_that_compose_with_small_letters_only(library):
    texts = [f"{letter}{mark}a" for letter, mark in zip("HJTWY", "̱̌̈̊̊")]
    texts += [f"{letter}{chr(mark)} The End." for letter in "AHIJKSTWYZ" for mark in range(0x300, 0x370)]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in WordEncoder(PATH).encode_all(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_two_generations_of_words(library, corpus, monkeypatch):
    from pactlens.llm import word_tokens

    monkeypatch.setattr(word_tokens, "KNOWN", 50)
    monkeypatch.setattr(word_tokens, "_PART", 2000)
    monkeypatch.setattr(word_tokens, "_BULK", 7)
    texts = [text or "" for _, text in corpus] + ["a ~ b~c ^ | x~ ~~~ ~", "e ́x \u200d ́ ~", "\u00a0word\u2028two ~"]
    got = [np.frombuffer(ids, "<u2").tolist() for ids in WordEncoder(PATH).encode_all(t.encode() for t in texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_dictionary_pieces_come_from_the_whole_document():
    ids = bytes(range(256)) * 40
    assert b"".join(token_files.spread(ids, 1000, 16)) == ids
    few = token_files.spread(ids, 100, 16)
    assert len(few) == 16 and all(len(x) == 100 for x in few) and ids.startswith(few[0]) and few[-1] in ids[-800:]
    assert token_files.spread(b"", 100, 16) == []


def test_a_generation_of_words_fits_a_dictionary_of_a_million_slots():
    held = dict.fromkeys(range(word_tokens.KNOWN + 15_000))  # a generation ends at a megabyte of text, with its new words
    assert sys.getsizeof(held) < 25e6
