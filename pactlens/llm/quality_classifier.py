"""Quality classifier: ordinal regression with cumulative links on graded ratings.

Grades are ordered, 0 the worst. One weight vector over hashed features of the text gives a score s, and ascending thresholds
t give P(grade <= j) = 1 / (1 + exp(s - t_j)). The expected grade and the tail probability P(grade >= j) select documents.

Features are the distinct words (A-Z lowered, outer punctuation off), their first four and five letters, and a few
shares of the text as a whole in steps. A document's score is the sum of its word features' weights, damped by a small
power of their number, plus its shape's weights. Features are counted over the fitting sample, and those in few of its documents have no weight.

The fit uses a bounded sample: the `sample` labelled documents with the lowest hashes of their ids (a row of each id), and one task. Every
document is then scored in one pass without a shuffle, by whole texts.

Defined results: a null text is empty. A label without a document, or a document without a label, is not fitted; labels
with null grades are left out, and of several labels of a document the lowest counts. Repeated rows are scored alike. Without
any usable label, or on an empty table, every document is kept, with even odds. A very long text is scored whole, by one
task, with its distinct words in memory. Other columns, whatever their names, are ignored, or carried along in `row`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pactlens.llm.common import forget_others, ids_and_text, texts, whole_rows

BITS = 20
SHAPE = 64  # first buckets, for shares of the text as a whole
EDGE = b".,;:!?\"'()[]"
DAMP = 0.25  # a text's word features count by their number to the power -DAMP, so that a few telling words tell in long texts too
KNOWN = 340_000  # words a worker remembers; a dictionary of over 349,525 takes twice the room
_PART = 1 << 18  # entries of the fitting sample that are computed at a time
SCORED = "doc_id long, expected_grade double, tail_probability double, kept boolean"


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its beginnings."""
    text = word.decode("utf-8", "replace")
    parts = {b"w" + word} | {b"p" + text[:n].encode() for n in (4, 5) if len(text) > n}
    return [SHAPE + zlib.crc32(part) % ((1 << BITS) - SHAPE) for part in sorted(parts)]


def shape_features(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """Buckets of: share of distinct words, of A-Z among letters, of marks, and the number of words, each in eight steps."""
    if not words:
        return [SHAPE - 1]
    upper, lower = sum(map(text.count, _UPPER)), sum(map(text.count, _LOWER))
    shares = (distinct / len(words), upper / (upper + lower + 1), min(1.0, 8 * sum(map(text.count, _MARKS)) / len(text)), min(1.0, len(words).bit_length() / 16))
    return [8 * n + min(7, int(8 * share)) for n, share in enumerate(shares)]


_UPPER = [bytes([c]) for c in range(65, 91)]
_LOWER = [bytes([c]) for c in range(97, 123)]
_MARKS = [bytes([c]) for c in b"#*$%&|<>!"]


def words_of(text: bytes) -> tuple[list[bytes], set[bytes]]:
    words = text.lower().split()
    return words, {word.strip(EDGE) for word in set(words)}


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self._known: dict[bytes, complex] = {}  # sum and number of weights, in one small object

    def score(self, text: bytes) -> float:
        words, distinct = words_of(text)
        shape = float(self.weights[shape_features(text, words, len(distinct))].sum())
        known = self._known
        if len(known) > KNOWN:
            known.clear()
        both = 0j
        for word in distinct:
            found = known.get(word)
            if found is None:
                held = self.weights[word_features(word)]
                found = known[word] = complex(float(held.sum()), np.count_nonzero(held))
            both += found
        return both.real * (1 + both.imag) ** -DAMP + shape

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ... in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(rows: list[list[int]] | list[np.ndarray], grades: np.ndarray, levels: int, fewest: int = 4, ridge: float = 0.3, steps: int = 60) -> Model:
    """Weights and thresholds of the largest penalised likelihood, by limited-memory quasi-Newton steps."""
    seen = np.zeros(1 << BITS, np.int64)
    for row in rows:
        np.add.at(seen, np.asarray(row, np.int64), 1)
    used = seen >= fewest
    used[:SHAPE] = seen[:SHAPE] > 0
    columns = np.flatnonzero(used)
    column = (np.cumsum(used) - 1).astype(np.int32)
    width, cuts, words_from = len(columns), levels - 1, int(np.searchsorted(columns, SHAPE))
    # The sample's entries, row by row, are held once, as 32-bit columns; all else is made for a part of them at a time.
    own = [column[row[used[row]]] for row in map(np.asarray, rows)]
    size = np.array([len(row) for row in own])
    damp = (1.0 + np.array([np.count_nonzero(row >= words_from) for row in own])) ** -DAMP
    flat = np.concatenate(own)
    del own, seen, used, column
    ends = np.cumsum(size)
    edges = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(_PART, int(ends[-1]), _PART)), [len(rows)]]))
    parts = [(int(a), int(b), int(ends[a] - size[a]), int(ends[b - 1])) for a, b in zip(edges, edges[1:])]

    def entries(part: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns, documents (from the part's first) and values of a part's entries."""
        at = flat[part[2] : part[3]].astype(np.int64)
        doc = np.repeat(np.arange(part[1] - part[0]), size[part[0] : part[1]])
        return at, doc, np.where(at >= words_from, damp[part[0] : part[1]][doc], 1.0)

    share = np.array([(grades >= j).mean() for j in range(1, levels)]).clip(1e-3, 1 - 1e-3)
    start = np.zeros(width + cuts)
    logits = np.log((1 - share) / share)
    start[width] = logits[0]
    start[width + 1 :] = np.log(np.maximum(np.diff(logits), 1e-2))  # gaps between thresholds stay above zero

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        gaps = np.exp(np.clip(x[width + 1 :], -20, 20))
        theta = np.concatenate([[x[width]], x[width] + np.cumsum(gaps)])
        s = np.zeros(len(rows))
        for part in parts:
            at, doc, value = entries(part)
            s[part[0] : part[1]] = np.bincount(doc, x[at] * value, minlength=part[1] - part[0])
        bounds = np.concatenate([[-60.0], theta, [60.0]])
        high, low = bounds[grades + 1] - s, bounds[grades] - s
        p_high, p_low = 1 / (1 + np.exp(-np.clip(high, -60, 60))), 1 / (1 + np.exp(-np.clip(low, -60, 60)))
        p = np.maximum(p_high - p_low, 1e-12)
        d_high, d_low = p_high * (1 - p_high) / p, p_low * (1 - p_low) / p
        grad = np.zeros_like(x)
        ds = d_high - d_low  # of the loss by the score
        for part in parts:
            at, doc, value = entries(part)
            np.add.at(grad, at, ds[part[0] : part[1]][doc] * value)
        grad[:width] += ridge * x[:width]
        by_theta = np.array([d_low[grades == j + 1].sum() - d_high[grades == j].sum() for j in range(cuts)])
        grad[width] = by_theta.sum()
        grad[width + 1 :] = np.cumsum(by_theta[::-1])[::-1][1:] * gaps
        return float(-np.log(p).sum() + ridge / 2 * (x[:width] ** 2).sum()), grad

    x, (value_now, grad) = start, loss(start)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, held = -grad, []
        for s, y in reversed(memory):
            a = (s @ direction) / (s @ y)
            held.append(a)
            direction = direction - a * y
        if memory:
            direction *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1])
        for (s, y), a in zip(memory, reversed(held)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope, step = grad @ direction, 1.0 if memory else 1 / (1 + np.abs(grad).sum())
        while True:
            value_new, grad_new = loss(x + step * direction)
            if value_new <= value_now + 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        moved, turned = step * direction, grad_new - grad
        if moved @ turned > 1e-12:
            memory = [*memory[-7:], (moved, turned)]
        done = value_now - value_new < 1e-5 * abs(value_now)
        x, value_now, grad = x + moved, value_new, grad_new
        if done:
            break
    weights = np.zeros(1 << BITS, np.float32)
    weights[columns] = x[:width]
    gaps = np.exp(np.clip(x[width + 1 :], -20, 20))
    return Model(weights, np.concatenate([[x[width]], x[width] + np.cumsum(gaps)]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 for toxic, 1 for poor, 2 for good; null where a rating is missing."""
    return F.when(toxic > 0, 0).when((toxic == 0) & (quality <= 0), 1).when((toxic == 0) & (quality > 0), 2)


def features(text: bytes) -> list[int]:
    """Distinct buckets of a text, in no order."""
    words, distinct = words_of(text)
    return list({f for word in distinct for f in word_features(word)}) + shape_features(text, words, len(distinct))


def train(documents: DataFrame, graded: DataFrame, levels: int = 3, sample: int = 8000, seed: int = 7) -> Model | None:
    """Model from `graded` (doc_id, grade): the `sample` documents with the lowest hashes of their ids."""
    usable = graded.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    # Of several rows of an id the one with the lowest hash of its text is fitted, so that repeated ids keep the bound.
    found = ids_and_text(documents).join(F.broadcast(chosen), "doc_id")
    first = F.min_by(F.struct("text", "grade"), F.xxhash64("text"))
    rows = found.groupBy("doc_id").agg(first.alias("held")).select("doc_id", "held.text", "held.grade").repartition(1)

    def fit_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        held = []
        for batch in batches:
            held += zip(batch.column("doc_id").to_pylist(), batch.column("grade").to_pylist(), (np.array(features(text), np.int32) for text in texts(batch)))
        held.sort(key=lambda row: row[0])
        if held:
            model = fit([row[2] for row in held], np.array([row[1] for row in held]), levels)
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes()], pa.binary()) for x in (used.astype(np.int32), model.weights[used], model.thresholds)],
                ["used", "weights", "thresholds"],
            )

    found = rows.mapInArrow(fit_one, "used binary, weights binary, thresholds binary").collect()
    if not found:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(found[0].used, np.int32)] = np.frombuffer(found[0].weights, np.float32)
    return Model(weights, np.frombuffer(found[0].thresholds).copy())


def score(documents: DataFrame, model: Model | None, least: int = 2, tail: float = 0.5, with_rows: bool = False) -> DataFrame:
    """expected_grade, tail_probability = P(grade >= `least`), and kept (at least `tail`) of each row. The weights go out
    with the tasks: at most 2**20 numbers, whatever the corpus. `with_rows` adds `row`, a struct of the row's own columns."""
    used = np.flatnonzero(model.weights).astype(np.int32) if model else np.zeros(0, np.int32)
    packed = (used, model.weights[used], model.thresholds) if model else None
    sent = documents.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        held = None
        if sent.value is not None:
            weights = np.zeros(1 << BITS, np.float32)
            weights[sent.value[0]] = sent.value[1]
            held = Model(weights, sent.value[2])
        for batch in batches:
            if held is None:
                expected, tails = np.full(batch.num_rows, 0.5), np.full(batch.num_rows, 0.5)
            else:
                by_grade = held.tails(np.array([held.score(text) for text in texts(batch)], float))
                expected, tails = by_grade.sum(axis=1), by_grade[:, least - 1]
            columns = [batch.column("doc_id"), pa.array(expected), pa.array(tails), pa.array((tails >= tail) | (held is None))]
            names = ["doc_id", "expected_grade", "tail_probability", "kept"]
            if with_rows:
                columns, names = [*columns, batch.column("row")], [*names, "row"]
            yield pa.RecordBatch.from_arrays(columns, names)

    if not with_rows:
        return ids_and_text(documents).mapInArrow(run, SCORED)
    read = whole_rows(documents).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "row")
    schema = StructType().add("doc_id", "long").add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")
    return read.mapInArrow(run, schema.add("row", documents.schema))


def classify(documents: DataFrame, labels: DataFrame, sample: int = 8000, tail: float = 0.5, with_rows: bool = False) -> DataFrame:
    """Every document scored by a model fitted on the labelled ones."""
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(documents, train(documents, graded, sample=sample), tail=tail, with_rows=with_rows)
