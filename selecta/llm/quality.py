"""Operator 10: quality by ordinal cumulative-link regression.

Ratings are ordered grades 0..K-1. One vector of hashed-text weights is shared
by all grades; ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold[k] - score)``. The model gives the expected
grade, and the tail probability ``P(grade >= least)`` by which texts are selected.

Features are means over a text's words (the word, its first four letters, its
shape: runs of capitals, small letters, digits, and other characters as they
are), and three figures on repetition in steps of a tenth.

Plan: a bounded sample of rated rows (``sample``) trains the weights on the driver; they
are broadcast, and all texts are scored where they lie, without a shuffle.

Defined results: a null or wordless text has grade 0 and tail probability 0.
Repeated rows give one row each. Without rated rows nothing is rejected but wordless texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import bounded_batches, byte_rows, lean, texts
from selecta.llm.hashed_text import WordScores, adam, bucket, counted, dense, labelled_sample, sample_rows

DIMS = 1 << 12
SAMPLE = 4_000
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """A word with runs of capitals, small letters and digits as A, a and 9."""
    return re.sub(r"(.)\1+", r"\1", _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", word))))


def word_features(word: bytes) -> list:
    w = word.decode("utf-8", "replace")
    return [bucket("w" + w, DIMS), bucket("p" + w[:4].lower(), DIMS), bucket("s" + shape(w), DIMS)]


def figures(words: list) -> list:
    """(feature, value) of a text's repetition: equal neighbours, distinct words in runs of 200, word length."""
    n = len(words)
    distinct = sum(len(set(words[i:i + 200])) for i in range(0, n, 200)) / n
    same = sum(a == b for a, b in zip(words, words[1:])) / n
    return [(bucket(f"{name}{int(min(v, 0.999) * 10)}", DIMS), float(n)) for name, v in
            (("same", same), ("distinct", distinct), ("length", sum(map(len, words)) / n / 40))]


def text_features(text: bytes | None) -> tuple:
    words = (text or b"").split()
    if not words:
        return [], []
    f, v = counted(words, word_features, figures(words))
    return f, [x / len(words) for x in v]


class Ordinal:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, score):
        """P(grade >= k) for k = 1.., per score."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - np.asarray(score)[..., None], -30, 30)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, steps: int = 250, l2: float = 2e-4) -> Ordinal:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps, so they stay ordered."""
    k = n_grades - 1
    cells = np.stack([grades >= j + 1 for j in range(k)], axis=1).astype(float)
    share = np.clip(cells.mean(0), 0.02, 0.98)
    start = -np.log(share / (1 - share))
    first = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    mean, spread = x.mean(0), x.std(0) + np.float32(1e-3)
    z = (x - mean) / spread

    def cuts(u):
        return np.cumsum(np.concatenate([u[:1], np.exp(u[1:])]))

    def gradient(u):
        w, t = u[:-k], cuts(u[-k:])
        below = 1.0 / (1.0 + np.exp(-np.clip(t - (z @ w)[:, None], -30, 30)))       # P(grade <= j)
        edge = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
        p = np.maximum(np.take_along_axis(edge, grades[:, None] + 1, 1) - np.take_along_axis(edge, grades[:, None], 1), 1e-9)[:, 0]
        slope = np.concatenate([np.zeros((len(z), 1)), below * (1 - below), np.zeros((len(z), 1))], axis=1)
        upper, lower = np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0], np.take_along_axis(slope, grades[:, None], 1)[:, 0]
        d_score = (upper - lower) / p / len(z)                                       # of the negative log-likelihood
        d_t = np.array([(-(upper * (grades == j)) + lower * (grades == j + 1)) @ (1 / p) for j in range(k)]) / len(z)
        d_u = np.array([d_t[j:].sum() * (1 if j == 0 else np.exp(u[len(w) + j])) for j in range(k)])
        return np.concatenate([z.T @ d_score.astype(np.float32) + l2 * w * len(w) ** 0.5, d_u])

    u = adam(gradient, np.concatenate([np.zeros(x.shape[1]), first]), steps, 0.02)
    w = u[:-k] / spread
    return Ordinal(w, cuts(u[-k:]) + mean @ w)


def fit(docs: DataFrame, ratings: DataFrame, grade, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Ordinal:
    """A model from at most ``sample`` rated rows; ``grade`` is a column expression of 0..n_grades-1."""
    wanted = labelled_sample(ratings, id_col, [grade.cast("int").alias("g")], sample)
    rows = sample_rows(docs, wanted, ["g"], text_features, id_col, text_col)
    rows = [r for r in rows if 0 <= r["g"] < n_grades and len(r["f"])]
    if not rows:
        return Ordinal(np.zeros(DIMS), np.full(n_grades - 1, -9.0))
    return fit_ordinal(dense(rows, DIMS), np.array([r["g"] for r in rows]), n_grades)


def _tails(rows: list, scores: WordScores, model: Ordinal) -> np.ndarray:
    """(rows, grades - 1): P(grade >= 1), P(grade >= 2), ..; zeros for a text without words."""
    out = np.zeros((len(rows), len(model.thresholds)))
    for i, text in enumerate(rows):
        words = (text or b"").split()
        if words:
            score = scores.total(words)[0] / len(words) + sum(model.weights[f] for f, _ in figures(words))
            out[i] = model.at_least(score)
    return out


def score(docs: DataFrame, model: Ordinal, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_tail, keep): keep where P(grade >= least) is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches):
        held = shared.value
        scores = WordScores(word_features, held.weights[:, None])
        for b in batches:
            tails = _tails(byte_rows(b.column("text")), scores, held)
            p = tails[:, least - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= 0.5)],
                                             names=["doc_id", "expected_grade", "p_tail", "keep"])

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_tail double, keep boolean")


def keep_good(docs: DataFrame, model: Ordinal, least: int = 1, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score` keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        held = shared.value
        scores = WordScores(word_features, held.weights[:, None])
        for b in batches:
            yield b.filter(pa.array(_tails(byte_rows(b.column(at)), scores, held)[:, least - 1] >= 0.5))

    return docs.mapInArrow(run, docs.schema)


#: Grades of the labels table: 0 poor, 1 fair (toxic), 2 good.
GRADES = 3


def label_grade():
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
