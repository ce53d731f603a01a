"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > j) = 1 / (1 + exp(threshold_j - score)) with one score for all thresholds, which are kept in order. The score is
the mean over a text's words of hashed weights (the lower-cased word, and the word's shape) plus a few weights of the
whole text (repeated neighbours, repeated words, repeated lines, length). Selection uses the expected grade and the
probability of a grade above a given one.

The model is fitted on the driver on at most `sample` labelled rows, the first by a hash of their id, and is a few hundred
kB. Scoring is one scan without a shuffle; weights of words are cached per task in a table that is emptied when it is full.

Defined results: a null text is empty; an empty text has the whole-text features only; rows without a grade aren't fitted;
of several grades of a document the lowest counts; without any graded row the score is 0 and each grade as likely; repeated
rows and null ids are scored like others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
WHOLE = 6
SCALE = 4.0
CACHE = 1 << 19

SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"([^\w\s])\1*"), lambda m: m[1])]


def shape(word: str) -> str:
    """Letters as a (or A for capitals), digits as 0, runs of other characters as one."""
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


def word_buckets(word: bytes) -> tuple[int, int]:
    import xxhash

    text = word.decode("utf-8", "replace")
    low = xxhash.xxh32_intdigest(text.lower().strip(".,;:!?").encode()) % BUCKETS
    return low, xxhash.xxh32_intdigest("shape " + shape(text)) % BUCKETS


def whole_text(words: list[bytes], raw: bytes) -> list[float]:
    n = len(words)
    if not n:
        return [0.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    return [
        sum(map(eq, words, words[1:])) / n,
        max(0.0, 1 - distinct / n - 0.1 * np.log10(n)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, float(np.log1p(n)) / 10),
        float(n < 10),
        1.0,
    ]


def raw_words(text: str | None) -> tuple[bytes, list[bytes]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw, raw.split()


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse features of a text, for fitting."""
    raw, words = raw_words(text)
    counts: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for b in word_buckets(w):
            counts[b] += n
    ids, values = list(counts), [SCALE * n / len(words) for n in counts.values()]
    return ids + [BUCKETS + i for i in range(WHOLE)], values + whole_text(words, raw)


class Model:
    """Weights by bucket, and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and j."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(ids: np.ndarray, values: np.ndarray, rows: np.ndarray, grades: np.ndarray, levels: int, steps: int = 250, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Penalised maximum likelihood by full-batch Adam. ids, values, rows: the sparse matrix; grades: 0 to levels - 1."""
    weights = np.zeros(BUCKETS + WHOLE)
    if not len(grades):
        return Model(weights, np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
    share = np.array([((grades > j).sum() + 0.5) / (len(grades) + 1) for j in range(levels - 1)])
    first, gaps = -np.log(share[0] / (1 - share[0])), np.log(np.maximum(1e-3, np.diff(-np.log(share / (1 - share)))))
    x = np.concatenate([weights, [first], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n, k = len(grades), len(weights)
    for step in range(1, steps + 1):
        thresholds = x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))])
        score = np.bincount(rows, values * x[ids], minlength=n)
        above = Model(x[:k], thresholds).above(score)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-12)
        slope = edge * (1 - edge)  # by score; the same against a threshold with the sign changed
        g_score = -(slope[at, grades] - slope[at, grades + 1]) / p
        g_threshold = np.zeros(levels - 1)
        np.add.at(g_threshold, grades[grades > 0] - 1, (slope[at, grades] / p)[grades > 0])
        np.add.at(g_threshold, grades[grades < levels - 1], -(slope[at, grades + 1] / p)[grades < levels - 1])
        later = np.cumsum(g_threshold[::-1])[::-1]
        g = np.concatenate([np.bincount(ids, values * g_score[rows], minlength=k) / n + l2 * x[:k], [later[0] / n], later[1:] * np.exp(x[k + 1 :]) / n])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(x[:k], x[k] + np.concatenate([[0.0], np.cumsum(np.exp(x[k + 1 :]))]))


def train(docs: DataFrame, graded: DataFrame, levels: int = 3, sample: int = 6000) -> Model:
    """graded: (doc_id, grade). Uses at most `sample` graded documents, the first by a hash of doc_id."""
    chosen = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounds what is broadcast and collected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [features(t.as_py()) for t in batch.column(1)]
            out = [batch.column(0), pa.array([a for a, _ in both], pa.list_(pa.int32())), pa.array([b for _, b in both], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(out, names=["grade", "ids", "vals"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("grade").cast("int"), "text")
    got = rows.mapInArrow(run, "grade int, ids array<int>, vals array<float>").toArrow()
    if not got.num_rows:
        return fit(*([np.zeros(0, int)] * 4), levels)
    ids, vals = got["ids"].combine_chunks(), got["vals"].combine_chunks()
    rows_of = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
    return fit(ids.values.to_numpy(), vals.values.to_numpy().astype(float), rows_of, got["grade"].to_numpy().astype(int), levels)


class WordWeights(dict):
    """Weight by word, computed when first asked for."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b = word_buckets(word)
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = float(self.weights[a] + self.weights[b])
        return got


def score(docs: DataFrame, model: Model, select_above: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, expected_grade, tail_prob, grade, kept): tail_prob is P(grade > select_above)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        cache, whole = WordWeights(weights), weights[BUCKETS:].astype(float)
        for batch in batches:
            scores = []
            for text in batch.column(1):
                raw, words = raw_words(text.as_py())
                mean = sum(map(cache.__getitem__, words)) * SCALE / len(words) if words else 0.0
                scores.append(mean + float(np.dot(whole, whole_text(words, raw))))
            s = np.array(scores, float)
            above = Model(weights, thresholds).above(s)
            tail = above[:, select_above]
            edge = np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], axis=1)
            grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
            out = [batch.column(0), pa.array(s), pa.array(above.sum(axis=1)), pa.array(tail), pa.array(grade, pa.int32()), pa.array(tail >= threshold)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "expected_grade", "tail_prob", "grade", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, tail_prob double, grade int, kept boolean")


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic: 0 poor, 1 good but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2))
    return labels.select("doc_id", grade.alias("grade"))
