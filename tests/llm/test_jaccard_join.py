import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pactlens.llm import jaccard_join
from pactlens.llm.common import BATCH_BYTES, ids_and_text
from pactlens.llm.jaccard_join import allocate, bands, bands_of, difference, folded, near_parts, shingle_set, signatures, similar, sketch


def plain_set(text, width=4):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[n : n + width]) for n in range(len(words) - width + 1)}


def plain_similar(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                label = [label[x] if one == label[y] else one for one in label]
    ids = {root: [i for (i, _), one in zip(rows, label) if one == root and i is not None] for root in set(label)}
    return sorted(((i, len(s), min(ids[one], default=None)) for (i, _), s, one in zip(rows, sets, label)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def near_copies(count, words, most, seed):
    """Texts that differ from one text, or from each other, in up to `most` words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    texts = []
    for _ in range(count):
        text = list(rng.choice(texts).split()) if texts and rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [f"v{rng.randrange(10**6)}"] * rng.randrange(3)
        texts.append(" ".join(text))
    return texts


def test_set_by_blocks_and_words(monkeypatch):
    from pactlens.llm import jaccard_join

    rng = random.Random(2)
    text = " ".join(f"Word{rng.randrange(40)}" for _ in range(3000)).encode()
    whole = shingle_set(text)
    assert len(whole) == len(plain_set(text.decode()))
    for block in (1, 7, 1000):
        monkeypatch.setattr(jaccard_join, "_BLOCK", block)
        assert np.array_equal(shingle_set(text), whole)
    assert len(shingle_set(b"a b c")) == 1 and len(shingle_set(b" \t")) == 0
    assert shingle_set(b"a b c")[0] not in shingle_set(b"a b")
    assert np.array_equal(shingle_set(b"A\x0bb c d"), shingle_set(b"a b\nC  D "))


@pytest.mark.parametrize("percent", [50, 70, 85, 95])
def test_a_similar_pair_always_meets(percent):
    """Any choice of levels that reaches the wanted sum finds every pair within the difference, also at its very limit."""
    rng = np.random.default_rng(percent)
    for _ in range(150):
        size = int(rng.integers(2, 300))
        common = rng.integers(0, 1 << 62, size).astype(np.uint64)
        smaller = int(rng.integers(-(-percent * size // 100), size + 1))
        both = -(-percent * (size + smaller) // (100 + percent))
        x = np.unique(common)
        y = np.unique(np.concatenate([common[:both], rng.integers(0, 1 << 62, smaller - both).astype(np.uint64)]))
        assert difference(len(x), len(y), percent) >= len(np.setxor1d(x, y))
        if np.array_equal(x, y):
            continue
        (kx, px), (ky, py) = signatures(x, percent), signatures(y, percent)
        own = py % 64 == 0
        indexed = {(int(k) >> 2, int(k) & 3) for k in ky[own]}
        meets = rng.integers(1, 50, len(kx))  # costs as they may come
        more = rng.integers(0, 50, len(kx))
        levels = allocate(len(x), px, (kx & np.uint64(3)).astype(np.int64), meets, more, percent)
        found = False
        for key, level in zip(kx.tolist(), levels.tolist()):
            whole = key & 3 < 2
            found |= level >= 1 and (key >> 2, 0) in indexed
            found |= level == 2 and whole and (key >> 2, 2) in indexed
        assert found, (len(x), len(y))


def test_a_sketch_differs_by_no_more_bits_than_sets_by_shingles(monkeypatch):
    rng = np.random.default_rng(5)
    for bits in ((64, 8192), (64, 128)):
        monkeypatch.setattr(jaccard_join, "_SKETCH_BITS", bits)
        for size in (1, 2, 40, 64, 65, 300, 1100):
            common = rng.integers(0, 1 << 63, size).astype(np.uint64)
            for extra in (0, 1, 3, size // 8, size):
                x, y = np.unique(common), np.unique(np.concatenate([common[extra // 2 :], rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
                if len(y):
                    width = min(len(sketch(x)), len(sketch(y)))
                    bits_apart = int(np.bitwise_count(folded(sketch(x), width) ^ folded(sketch(y), width)).sum())
                    assert bits_apart <= len(np.setxor1d(x, y))


def test_parts_keep_similar_sets_together_and_cut_others():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(4):
        one = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        sets += [np.unique(np.concatenate([one[n:], rng.integers(0, 1 << 63, n).astype(np.uint64)])) for n in (0, 10, 20, 30)]
    first = near_parts(np.array([len(x) for x in sets]), [sketch(x) for x in sets], 85)
    assert first[:3].tolist() == [0, 0, 0] and first[4:7].tolist() == [4, 4, 4] and len(set(first.tolist())) >= 4
    assert all(first[n] in (n // 4 * 4, n) for n in range(len(sets)))


@pytest.mark.parametrize("narrowed", [1 << 14, 5])
def test_large_group_of_chance_meetings_falls_apart(make_documents, monkeypatch, narrowed):
    """Texts with a passage in common are one group; only near copies stay together, before any text is fetched."""
    monkeypatch.setattr(jaccard_join, "_NARROWED", narrowed)
    rng = random.Random(9)
    passage = " ".join(f"p{n}" for n in range(40))
    texts = []
    for _ in range(25):
        text = [f"u{rng.randrange(10**6)}" for _ in range(14)]
        texts += [passage + " " + " ".join(text), passage + " " + " ".join(text[:-1] + ["other"])]
    rows = list(enumerate(texts))
    seen = []
    links = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda documents, allocated, grouped, *rest: seen.append(grouped) or links(documents, allocated, grouped, *rest))
    assert got(similar(make_documents(rows), leaf=20)) == plain_similar(rows)
    if narrowed > len(rows):
        (groups,) = seen
        assert groups.where("NOT small").isEmpty() and groups.groupBy("root").count().agg(F.max("count")).first()[0] == 2


def test_bands_cover_all_sizes():
    known = bands(85, 10**7)
    assert known[0].low == 1 and all(a.high + 1 == b.low for a, b in zip(known, known[1:]))
    for size in (1, 2, 3, 7, 8, 11, 100, 12345):
        found = bands_of(size, 85)
        assert found[0].low <= size <= found[0].high and found[-1].low <= -(-85 * size // 100)


@pytest.mark.parametrize("leaf", [4096, 24, 6])
def test_groups_of_near_copies(make_documents, leaf):
    texts = near_copies(90, 60, 4, seed=1) + near_copies(40, 25, 2, seed=2) + near_copies(30, 9, 1, seed=3)
    rng = random.Random(4)
    passage = " ".join(f"p{n}" for n in range(40))
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) + " " + passage for _ in range(30)]
    texts += ["", None, " \t", "one two", "One  two", "one two three"] + [texts[0]] * 20
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=-5))
    assert got(similar(make_documents(rows).repartition(3), leaf=leaf)) == plain_similar(rows)


@pytest.mark.parametrize("percent", [60, 95])
def test_other_thresholds(make_documents, percent):
    rows = list(enumerate(near_copies(60, 40, 5, seed=percent)))
    assert got(similar(make_documents(rows), percent=percent)) == plain_similar(rows, percent)


def test_corpus(make_documents, corpus):
    assert got(similar(make_documents(corpus))) == plain_similar(corpus)


def test_rows_with_odd_values(make_documents):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "x y z w"), (3, "x y z w"), (3, "other text of the id"), (9, "x y z w"), (None, None), (None, ""), (4, None), (4, "")]
    rows += [(20, "long text of words " * 60_000), (21, "long text of words " * 60_000 + "end")]
    frame = make_documents(rows, cid=1, n=2, keys="k", said=5, sig=0, component_id=7).withColumn("root", F.lit(None))
    assert got(similar(frame)) == plain_similar(rows)


def test_empty_table(make_documents):
    frame = similar(make_documents([(1, "a")]).where("false"))
    assert frame.collect() == [] and frame.columns == ["doc_id", "n_shingles", "component_id"]


def test_texts_reach_workers_in_small_batches(spark, make_documents):
    make_documents([])
    documents = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ten bytes "), 500).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    found = ids_and_text(documents).mapInArrow(sizes, "n long, size long").collect()
    assert sum(row.n for row in found) == 4000 and max(row.size for row in found) < 2 * BATCH_BYTES[1]


def test_batches_of_few_rows_give_the_same_groups(spark, make_documents):
    texts = near_copies(60, 30, 4, 5)
    rows = [(n, text) for n, text in enumerate([*texts, *texts[:20], "", None])]
    documents = make_documents(rows).coalesce(1)
    before = spark.conf.get(BATCH_BYTES[0])
    spark.conf.set(BATCH_BYTES[0], "1000")
    try:
        assert got(similar(documents)) == plain_similar(rows)
    finally:
        spark.conf.set(BATCH_BYTES[0], before)


def test_known_words_fit_a_dictionary_of_half_a_million_slots():
    assert sys.getsizeof(dict.fromkeys(range(jaccard_join._KNOWN))) < 13e6
