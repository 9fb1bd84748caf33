"""Fingerprints and components against a plain version in Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from pactlens.llm import simhash
from pactlens.llm.common import reach_package


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(codes, differences=4):
    """Smallest position reachable, for each position."""
    label = list(range(len(codes)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    array = np.array(codes, np.uint64)
    for n in range(len(codes)):
        for m in np.flatnonzero(np.bitwise_count(array[n + 1 :] ^ array[n]) <= differences) + n + 1:
            a, b = root(n), root(int(m))
            label[max(a, b)] = min(a, b)
    return [root(n) for n in range(len(codes))]


@pytest.mark.parametrize("leaf_size, blocks", [(simhash.LEAF, None), (8, 6)])
def test_corpus(spark, make_documents, corpus, leaf_size, blocks):
    rows = corpus + [(1000, None), (1001, ""), (1002, " \n"), (1003, "two words"), (1004, "TWO\twords"), (1004, "TWO\twords"), (1005, "É e"), (1006, "é e")]
    got = {}
    for row in simhash.near_duplicates(make_documents(rows, fp=1, root="x", component_id=2), leaf_size=leaf_size, blocks=blocks).collect():
        got.setdefault(row.doc_id, set()).add((row.fingerprint, row.component_id))
    codes = [plain_fingerprint(text) for _, text in rows]
    roots = plain_components(codes)
    want = {}
    for (doc_id, _), code, root in zip(rows, codes, roots):
        want.setdefault(doc_id, set()).add((f"{code:016x}", rows[root][0]))
    assert got == want


def test_clusters_that_span_leaves(spark):
    """Many codes around a few centres, chains, and neighbours at exactly 4 and 5 bits."""
    reach_package(spark)
    draw = random.Random(5)
    codes = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(120):
            codes.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))))
    chain = draw.getrandbits(64)
    for n in range(12):
        codes.add(chain := chain ^ sum(1 << b for b in range(5 * n, 5 * n + 4)))
    lone = draw.getrandbits(64)
    codes |= {lone, lone ^ 0b11111} | {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    codes = sorted(codes)
    signed = [code - (1 << 64) if code >> 63 else code for code in codes]
    classes = spark.createDataFrame([(code,) for code in signed], "fp long").repartition(3)
    roots = plain_components(codes)
    for leaf_size, blocks in ((16, 5), (512, 6), (16, 7)):
        found = simhash.components(simhash.links(classes, leaf_size=leaf_size, blocks=blocks)).collect()
        groups = {row.node: row.root for row in found}
        got = {}
        for n, code in enumerate(signed):
            got.setdefault(groups.get(code, code), set()).add(n)
        want = {}
        for n, root in enumerate(roots):
            want.setdefault(root, set()).add(n)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_null_ids_and_empty_table(make_documents):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (None, "z"), (None, None)]
    got = {(r.doc_id, r.component_id, r.fingerprint == "0" * 16) for r in simhash.near_duplicates(make_documents(rows)).collect()}
    assert {(None, 7, False), (7, 7, False)} <= got and (None, None, True) in got
    assert simhash.near_duplicates(make_documents([])).count() == 0


def test_gray_rank():
    codes = np.arange(256, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert simhash.gray_rank(gray).tolist() == codes.tolist()


def test_very_long_text():
    words = ("alpha beta gamma delta epsilon " * 40_000).encode()
    assert simhash.fingerprint(words) == plain_fingerprint(words.decode())
