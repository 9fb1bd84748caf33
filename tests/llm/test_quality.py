"""Classifier on held-out labels; quality rules against plain counts and distances."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pactlens.llm import packing, quality_classifier, quality_rules, word_tokens
from pactlens.llm.common import forget_others, table

BIGGER = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    documents, labels = table(spark, BIGGER, "documents"), table(spark, BIGGER, "labels")
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    found = quality_classifier.classify(documents, labels.where(~held_out)).join(labels.where(held_out), "doc_id")
    shares = {
        row.grade: row.kept
        for row in found.withColumn("grade", quality_classifier.grade_of(F.col("quality"), F.col("toxic"))).groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    }
    assert shares[2] >= 0.99 and shares[0] <= 0.15 and shares[1] <= 0.3


def test_likelihood_gradient_leads_to_ordered_grades():
    draw = np.random.default_rng(1)
    base = quality_classifier.SHAPE
    rows, grades = [], []
    for _ in range(300):
        grade = int(draw.integers(0, 3))
        rows.append([base + grade, base + 10 + int(draw.integers(0, 5))])
        grades.append(grade)
    model = quality_classifier.fit(rows, np.array(grades), 3)
    scores = [float(model.weights[base + grade]) for grade in range(3)]
    assert scores == sorted(scores) and model.thresholds[0] < model.thresholds[1]
    tails = model.tails(np.array(scores))
    assert ((0 <= tails) & (tails <= 1)).all() and (tails[:, 0] >= tails[:, 1]).all()


def plain_features(text):
    """Distinct buckets of a text, word by word."""
    found = set()
    for word in {w.strip(b".,;:!?\"'()[]") for w in text.encode().lower().split()}:
        decoded = word.decode()
        parts = {b"w" + word} | {b"p" + decoded[:n].encode() for n in (4, 5) if len(decoded) > n}
        found |= {quality_classifier.SHAPE + zlib.crc32(part) % (2**quality_classifier.BITS - quality_classifier.SHAPE) for part in parts}
    return found


def test_scores_against_a_plain_version(spark, folder, corpus):
    """Score, tails, expected grade and verdict of every document, from the model's numbers in plain Python."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    graded = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.train(documents, graded)
    got = {r.doc_id: r for r in quality_classifier.classify(documents, labels).collect()}
    assert len(got) == len(corpus)
    for doc_id, text in corpus:
        words = (text or "").encode().lower().split()
        distinct = {w.strip(b".,;:!?\"'()[]") for w in words}
        # A word's buckets count once a word, so buckets that words share count once for each of them.
        held = [float(model.weights[f]) for word in distinct for f in quality_classifier.word_features(word)]
        known = sum(w != 0 for w in held)
        shape = sum(float(model.weights[f]) for f in quality_classifier.shape_features((text or "").encode(), words, len(distinct)))
        score = sum(held) * (1 + known) ** -0.25 + shape
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds.tolist()]
        row = got[doc_id]
        assert row.tail_probability == pytest.approx(tails[1], abs=1e-4) and row.expected_grade == pytest.approx(sum(tails), abs=2e-4)
        assert row.kept == (row.tail_probability >= 0.5)
    assert plain_features("Word, words!") == {f for w in (b"word", b"words") for f in quality_classifier.word_features(w)}


def test_fit_is_a_minimum_of_the_plain_likelihood():
    draw = np.random.default_rng(4)
    base, rows, grades = quality_classifier.SHAPE, [], []
    for _ in range(200):
        grade = int(draw.integers(0, 3))
        rows.append([base + n for n in range(12) if draw.random() < (0.6 if n % 3 == grade else 0.3)] + [int(draw.integers(0, 8))])
        grades.append(grade)
    model = quality_classifier.fit(rows, np.array(grades), 3, fewest=1, ridge=0.3, steps=300)

    def loss(weights, thresholds):
        total = 0.15 * float((weights**2).sum())
        bounds = [-60.0, *thresholds, 60.0]
        for row, grade in zip(rows, grades):
            words = [f for f in row if f >= base]
            score = sum(weights[f] for f in words) * (1 + len(words)) ** -0.25 + sum(weights[f] for f in row if f < base)
            total -= math.log(1 / (1 + math.exp(score - bounds[grade + 1])) - 1 / (1 + math.exp(score - bounds[grade])))
        return total

    weights, thresholds = model.weights.astype(float), model.thresholds
    least = loss(weights, thresholds)
    for _ in range(20):
        step = np.zeros_like(weights)
        step[[base + int(draw.integers(0, 12)), int(draw.integers(0, 8))]] = draw.normal(size=2) * 0.1
        assert loss(weights + step, thresholds) > least - 0.02
        assert loss(weights, thresholds + draw.normal(size=2) * 0.05) > least - 0.02


def test_classifier_edges(spark, make_documents):
    rows = [(n, f"good words here {n}") for n in range(20)] + [(100 + n, "idiot words here") for n in range(20)] + [(500, None), (501, ""), (None, "x"), (501, "")]
    labels = spark.createDataFrame(
        [(n, 1, 0) for n in range(20)] + [(100 + n, 1, 1) for n in range(20)] + [(7, None, 0), (None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int"
    ).withColumn("text", F.lit("clash"))
    got = quality_classifier.classify(make_documents(rows, kept=1, grade=2), labels).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[3] and not verdict[103]
    assert all(r.kept for r in quality_classifier.classify(make_documents(rows), labels.limit(0)).collect())
    assert quality_classifier.classify(make_documents([]), labels).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {n + k for n in range(len(words) - 2) if windows[tuple(words[n : n + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(make_documents, corpus):
    phrase = "one two three four "
    rows = corpus + [
        (900, None), (901, ""), (902, " \n\t\x0b"), (903, "a"), (904, "a b c"), (905, "a a a a"), (906, phrase * 20), (906, phrase * 20),
        (907, "\n".join(["same line", "same line ", "same line", "", " ", ""])), (908, "éÀ ß #*$ |<>%&\r\nx y"), (909, (phrase * 30_000) + "z"),
        (910, "🙂 " * 60), (911, " ".join(f"w{n}" for n in range(300)) + " w1 w2 w3"), (None, "x y"),
    ]
    got = quality_rules.judge(make_documents(rows, t="x", w=1, classes=2)).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(doc_id, *plain_counts(text or "")) for doc_id, text in rows]
    assert sorted(map(str, [tuple(r[c] for c in columns) for r in got])) == sorted(map(str, want))
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.judge(make_documents([])).count() == 0


def plain_distance(p, q):
    p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
    total = 0.0
    for a, b in zip(p, q):
        total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(total / 2, 0))


def test_distances(spark, folder):
    counts = quality_rules.with_counts(table(spark, folder, "documents"))
    rows = {r.doc_id: r for r in counts.collect()}
    totals = {}
    for r in rows.values():
        for name in ("classes", "commons"):
            sums = totals.setdefault((r.lang, name), [0] * len(r[name]))
            for n, x in enumerate(r[name]):
                sums[n] += x
        assert sum(r["classes"]) >= r.word_chars and sum(r["commons"]) == r.n_words
    for r in quality_rules.judge(table(spark, folder, "documents")).collect():
        held = rows[r.doc_id]
        assert r.class_distance == pytest.approx(plain_distance(held["classes"], totals[held.lang, "classes"]), abs=1e-9)
        assert r.word_distance == pytest.approx(plain_distance(held["commons"], totals[held.lang, "commons"]), abs=1e-9)


def test_junk_is_rejected_and_clean_text_kept(spark):
    judged = quality_rules.judge(table(spark, BIGGER, "documents")).join(table(spark, BIGGER, "labels"), "doc_id").where("n_words >= 50")
    row = judged.agg(
        F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("poor")
    ).first()
    assert row.good >= 0.99 and row.poor <= 0.5


def test_a_fit_in_parts_takes_little_memory_and_gives_the_same_model(monkeypatch):
    draw = np.random.default_rng(3)
    rows = [np.append(quality_classifier.SHAPE + draw.integers(0, 200_000, 800), draw.integers(0, 30)).astype(np.int32) for _ in range(3000)]
    grades = draw.integers(0, 3, len(rows))
    tracemalloc.start()
    quality_classifier.fit(rows, grades, 3, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, rows))
    few, grades = [row[-60:] for row in rows[:90]] + [rows[0][:0]], np.append(grades[:90], 1)
    whole = quality_classifier.fit(few, grades, 3, fewest=1)
    for part in (1, 50, 1000):
        monkeypatch.setattr(quality_classifier, "_PART", part)
        model = quality_classifier.fit(few, grades, 3, fewest=1)
        assert np.array_equal(model.weights, whole.weights) and np.array_equal(model.thresholds, whole.thresholds)


def test_classifier_tasks_drop_the_words_that_packing_left(spark, make_documents):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    documents = make_documents([(1, "one two three"), (2, None)])
    model = quality_classifier.Model(np.zeros(1 << quality_classifier.BITS, np.float32), np.array([-1.0, 1.0]))
    word_tokens.encoder(tokenizer)
    assert word_tokens.encoder.cache_info().currsize == 1
    forget_others()
    assert word_tokens.encoder.cache_info().currsize == 0
    packed = packing.pieces(documents, tokenizer).count()
    assert packed == 2 and quality_classifier.score(documents, model).count() == 2
    assert packing.pieces(documents, tokenizer).count() == 2
