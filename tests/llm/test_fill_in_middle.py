import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pactlens.llm.fill_in_middle import FAN, Marks, UnitIndex, rearrange, restore, transform

PLACES = re.compile(r"[^\n]*\n|[^\n]+")


def plain(doc_id, text, seed=7, rate=100, spm_rate=50):
    """The contract, over str and a list of lines."""
    text = text or ""
    lines = PLACES.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[n : n + 8], 16) for n in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    prefix, middle, suffix = ("".join(lines[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < spm_rate:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.text(alphabet="ab é\n\n\r中😀<PSM>", max_size=200))
def test_as_stated(doc_id, text):
    units, form, prefix, middle, output = rearrange(doc_id, text.encode())
    assert (units, form, prefix, middle, output.decode()) == plain(doc_id, text)
    assert restore(output, form).decode() == text


def test_every_rank_of_a_deep_index():
    random.seed(5)
    lines = ["é" * random.randrange(4) + "\n" for _ in range(FAN**2 * 3 + 5)] + ["end"]
    index = UnitIndex("".join(lines).encode())
    assert index.units == len(lines)
    for rank in range(len(lines) + 1):
        head = "".join(lines[:rank])
        assert index.cut(rank) == (rank, len(head), len(head.encode()))


def test_marks_that_overlap_are_refused():
    for marks in (Marks(b"<P>", b"<P>x", b"<M>"), Marks(b"aba", b"<S>", b"<M>"), Marks(b"", b"<S>", b"<M>"), Marks(b"xy", b"yz", b"<M>")):
        with pytest.raises(ValueError):
            marks.checked()
    Marks().checked()


def test_rows_with_odd_values(spark, make_documents):
    long_text = "line of a very long text é\n" * 200_000
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\ny"), (None, None), (2, ""), (3, None), (4, "has <S> inside\n"), (5, "\n\n"), (-6, long_text), (7, " \r\n\t")]
    got = transform(make_documents(rows, n=1, form="mine", output="theirs", prefix_chars=2), with_text=True).collect()
    want = []
    for doc_id, text in rows:
        units, form, prefix, middle, output = plain(doc_id, text)
        want.append((doc_id, units, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), output))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_rates(make_documents):
    rows = [(n, "a\nb\nc\n") for n in range(400)]
    forms = [r.form for r in transform(make_documents(rows), rate=50, spm_rate=100).collect()]
    assert set(forms) == {"plain", "spm"} and 120 < forms.count("spm") < 280
    assert [r.form for r in transform(make_documents(rows), rate=50, spm_rate=100).orderBy("doc_id").collect()] == [plain(n, t, 7, 50, 100)[1] for n, t in rows]


def test_empty_table(make_documents):
    frame = transform(make_documents([(1, "a")]).where("false"))
    assert frame.collect() == [] and frame.columns[:3] == ["doc_id", "n", "form"]
