"""Every stage against plain Python on what the stage before it kept."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_quality import plain_counts
from test_simhash import plain_components, plain_fingerprint
from test_suffix_dedup import plain_marks
from tokenizers import Tokenizer

import corpus_pipeline
from pactlens.llm import quality_classifier
from pactlens.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Each stage's input and output as rows, with odd documents added to the table."""
    base = tmp_path_factory.mktemp("pipeline")
    words = " ".join(f"the of and word{n}" for n in range(30))
    other = " ".join(f"the of and other{n}" for n in range(30))
    odd = [(9001, None), (9002, ""), (None, None), (None, words), (9003, words), (9003, words), (9003, other), (9004, words + " end"), (9005, words), (9005, "idiot " * 60), (None, other)]
    extra = spark.createDataFrame([(i, t, "en", None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = table(spark, folder, "documents").unionByName(extra)
    names = {"row": F.lit(1), "number": F.lit("x"), "kept": F.lit(False), "component_id": F.lit(2.5), "kept_text": F.lit("y")}
    docs = docs.withColumns(names)
    held = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"file://{base}/{n}")
        docs = spark.read.parquet(f"file://{base}/{n}")
        held.append((name, before, docs))
    return held


def rows(frame):
    return [tuple(r) for r in frame.select(COLUMNS).collect()]


def test_columns_are_carried(steps):
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert all((r["row"], r["number"], r["kept"]) == (1, "x", False) for r in after.collect())


def test_classifier_drops_what_the_model_rejects(spark, folder, steps):
    """The model's own scores, taken one by one in plain Python."""
    _, before, after = steps[0]
    labels = table(spark, folder, "labels")
    graded = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.train(before, graded)
    kept = [r for r in rows(before) if 1 / (1 + 2.718281828459045 ** (model.thresholds[1] - model.score((r[1] or "").encode()))) >= 0.5]
    assert Counter(rows(after)) == Counter(kept) and len(kept) < before.count()


def test_rules_drop_rows_that_fail(steps):
    _, before, after = steps[1]
    failed = Counter(r for r in rows(before) if plain_counts(r[1] or "")[-1])
    kept = Counter(rows(after))
    assert failed and not failed & kept
    assert not kept - Counter(rows(before))
    clean = [r for r in rows(before) if r[0] is not None and r[0] < 9000 and not plain_counts(r[1] or "")[-1]]
    assert sum(kept[r] for r in clean) >= 0.8 * len(clean)


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[2]
    held = sorted(rows(before), key=lambda r: (r[0] is None, r[0] or 0))
    roots = plain_components([plain_fingerprint(r[1]) for r in held])
    groups = {}
    for row, root in zip(held, roots):
        groups.setdefault(root, []).append(row)
    kept = Counter(rows(after))
    assert sum(kept.values()) == len(groups)
    for group in groups.values():
        least = [r for r in group if r[0] == group[0][0]]
        assert sum(kept[r] for r in set(least)) >= 1


def test_repeated_passages_go(steps):
    _, before, after = steps[3]
    want = Counter()
    held = rows(before)
    for (doc_id, text, lang, source, n_chars), gone in zip(held, plain_marks([(r[0], r[1]) for r in held])):
        if text is not None and any(gone):
            text = bytes(b for b, g in zip(text.encode(), gone) if not g).decode("utf-8", "ignore")
            n_chars = len(text)
        want[doc_id, text, lang, source, n_chars] += 1
    assert Counter(rows(after)) == want


def test_packing_holds_every_token(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, before, after = steps[4]
    want = Counter()
    for doc_id, text, *_ in rows(before):
        want[doc_id] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert got == want and max(fill.values()) <= 2048


def test_whole_run(spark, folder):
    assert set(corpus_pipeline.run(spark, folder).columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_empty_table(spark, folder):
    docs = table(spark, folder, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
