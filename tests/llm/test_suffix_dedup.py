"""Removed bytes against a plain look-up of every window."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pactlens.llm import suffix_dedup


def plain_marks(rows, length=50):
    """For each row, which bytes of its text go, window by window."""
    texts = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    order = lambda doc_id: 2**63 if doc_id is None else doc_id
    first = {}
    for doc_id, text in texts:
        for at in range(len(text) - length + 1):
            window = text[at : at + length]
            first[window] = min(first.get(window, 2**63), order(doc_id))
    out = []
    for doc_id, text in texts:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < order(doc_id):
                gone[at : at + length] = b"\x01" * length
        out.append(gone)
    return out


def plain(rows, length=50):
    """The contract's columns."""
    out = []
    for (doc_id, text), gone in zip(rows, plain_marks(rows, length)):
        text = (text or "").encode()
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((doc_id, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted([tuple(r)[:5] for r in frame.collect()], key=str)


@pytest.mark.parametrize("settings", [{}, {"batch_bytes": 20_000, "bucket_bytes": 50_000}, {"batch_bytes": 20_000, "bucket_bytes": 50_000, "hot": 2}])
def test_planted_repeats(make_documents, corpus, settings):
    draw = random.Random(3)
    letters = "abcdefgh éß日🙂"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    passage, edge = word(400), word(60).encode()[:50].decode("utf-8", "ignore")
    rows = list(corpus[:60])
    for n in range(25):
        rows.append((1000 + draw.randrange(400), word(draw.randrange(200)) + passage[draw.randrange(200) :][: draw.randrange(250)] + word(draw.randrange(90)) + edge))
    rows += [
        (5, None), (6, ""), (7, "x" * 49), (8, "x" * 50), (9, "x" * 51), (10, "x" * 5000), (3000, "x" * 5000), (3001, "ab" * 600), (3002, "ba" * 300), (3003, "y" + passage),
        (None, passage), (None, passage), (3004, passage), (3004, passage), (3005, passage[:30]), (3006, passage * 3), (3007, "é" * 40), (3008, "è" + "é" * 40),
    ]
    draw.shuffle(rows)
    documents = make_documents(rows, batch=1, packed="x", n_bytes=3).repartition(3)
    assert got(suffix_dedup.remove_repeats(documents, **settings)) == plain(rows)


def test_kept_text_and_empty_table(make_documents):
    shared = "".join(chr(97 + n % 26) + str(n) for n in range(40))
    rows = [(1, shared), (2, "before " + shared + " after")]
    texts = {r.doc_id: r.kept_text for r in suffix_dedup.remove_repeats(make_documents(rows), with_text=True).collect()}
    assert texts == {1: shared, 2: "before  after"}
    assert suffix_dedup.remove_repeats(make_documents([])).count() == 0
    assert got(suffix_dedup.remove_repeats(make_documents([(1, None)]))) == plain([(1, None)])


def test_rows_are_carried(make_documents):
    shared = "".join(chr(97 + n % 26) + str(n) for n in range(40))
    rows = [(1, shared), (2, "before " + shared), (2, None), (None, shared + "é"), (3, "")] * 9
    frame = make_documents(rows, row=5, batch="b", kept_text=None, n_removed=2.5)
    got_rows = suffix_dedup.remove_repeats(frame, with_text=True, with_rows=True, batch_bytes=300).collect()
    assert sorted(str((r.doc_id, r.kept_text is None)) for r in got_rows) == sorted(str((i, t is None)) for i, t in rows)
    assert all(r.row.doc_id == r.doc_id and r.row["row"] == 5 and r.row.batch == "b" and r.row.n_removed == 2.5 and "text" not in r.row for r in got_rows)


def test_one_very_long_text(make_documents):
    draw = random.Random(6)
    long_text = " ".join(str(draw.randrange(10**9)) for _ in range(2_000_000))  # about 20 MB
    rows = [(1, "head|" + long_text[5_000_000:5_100_000]), (2, long_text), (3, long_text[-70:])]
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(make_documents(rows)).collect()}
    assert found[1][1] == 0 and found[2][1:] == (100_000, 1) and found[3] == (70, 70, 1)


def test_merge_of_transforms_orders_suffixes():
    draw = random.Random(8)
    for shards in (1, 2, 3, 4):
        strings = ["".join(draw.choice("ab") for _ in range(draw.randrange(12, 40))).encode() for _ in range(20)]
        ids = np.array([draw.randrange(100) for _ in strings])
        want = {}
        for string, i in zip(strings, ids.tolist()):
            for at in range(len(string) - 9):
                want[string[at : at + 10]] = min(want.get(string[at : at + 10], 10**9), i)
        for string, minima in zip(strings, suffix_dedup.window_minima(strings, ids, 10, shards)):
            assert minima.tolist() == [want[string[at : at + 10]] for at in range(len(string) - 9)]


def test_suffix_order():
    draw = random.Random(2)
    for _ in range(30):
        text = bytes(draw.choice(b"\x00ab") for _ in range(draw.randrange(1, 80)))
        values = np.frombuffer(text, np.uint8)
        assert suffix_dedup.suffix_order(values).tolist() == sorted(range(len(text)), key=lambda n: text[n:])


def test_a_bucket_takes_little_more_than_its_strings():
    draw, many = random.Random(9), 30_000
    strings = [draw.randbytes(64).replace(b"\xff", b"\xfe") for _ in range(many)]
    keys = [n // 2 * 2 if n % 5 == 0 else n for n in range(many)]  # some anchors have two strings
    raw = suffix_dedup._zip(
        np.array(keys, "<u8"), np.full(many, 64, "<i4"), np.arange(many, dtype="<i4"), np.arange(many, dtype="<i8"), b"".join(strings)
    )
    table = pa.table({"batch": pa.array([1, 2], pa.int64()), "strings": pa.array([raw, raw], pa.binary())})
    suffix_dedup._resolve(table.slice(0, 1), 50)
    tracemalloc.start()
    try:
        answers = suffix_dedup._resolve(table, 50)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    names, counts, least = suffix_dedup._unzip(answers["answer"][1].as_py(), "<i4", "<i4", "<i8")
    assert answers["batch"].to_pylist() == [1, 2]
    assert names.tolist() == least.tolist() == list(range(many)) and set(counts.tolist()) == {15}
    assert peak < many * 64 * 12  # 18 times the strings with objects for every key and answer
