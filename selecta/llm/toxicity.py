"""Operator 1: toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each model is a logistic
regression over hashed text features and the log-odds of all earlier
categories. For training, those log-odds come from models that have not seen
the text (out-of-fold); for prediction, from the earlier models.

Features are a text's distinct words, with their 4- and 5-letter beginnings.
Only features that speak for a category (smoothed log-odds, z-score) are kept,
so a long clean text gathers no evidence by its length.

Plan: a bounded sample of labelled rows (``sample``) trains the chain on the
driver; the weights are broadcast; all texts are scored where they lie.

Defined results: null or wordless text: probability of the intercepts, as for
any text without evidence. Repeated rows give one row each. Without labels of
both classes a category's probability is the share of its positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import byte_rows, texts
from selecta.llm.decontaminate import words
from selecta.llm.hashed_text import WordScores, adam, bucket, counted, labelled_sample, sample_rows

DIMS = 1 << 16
SAMPLE = 6_000
FOLDS = 5


def word_features(word: bytes) -> list:
    w = word.decode("utf-8")
    return [bucket("w" + w, DIMS)] + [bucket(f"{n}{w[:n]}", DIMS) for n in (4, 5) if len(w) >= n]


def text_features(text: bytes | None) -> tuple:
    return counted(list(set(words(text or b""))), word_features)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Features:
    """Sparse features of the sampled rows, with dense columns after them (earlier log-odds, ones)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, more: np.ndarray):
        self.row, self.col, self.value, self.width, self.more = row, col, value, width, more

    def __len__(self):
        return len(self.more)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], len(self)) + self.more @ w[self.width:]

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transposed product."""
        return np.concatenate([np.bincount(self.col, self.value * r[self.row], self.width), r @ self.more])

    def of(self, rows: np.ndarray) -> "Features":
        """The rows of a mask."""
        held = rows[self.row]
        return Features((np.cumsum(rows) - 1)[self.row[held]], self.col[held], self.value[held], self.width, self.more[rows])

    def beside(self, columns: np.ndarray) -> "Features":
        return Features(self.row, self.col, self.value, self.width, np.concatenate([self.more, columns], axis=1))


def _fit(x: Features, y: np.ndarray, steps: int = 150, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression; the last weight is the intercept."""
    x = x.beside(np.ones((len(x), 1)))
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(x.width + x.more.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    if y.min() == y.max():
        return w
    ridge = np.full(len(w), l2)
    ridge[-1] = 0
    return adam(lambda u: x.back(_sigmoid(x @ u) - y) / len(y) + ridge * u, w, steps, 0.2)


def _apply(w: np.ndarray, x: Features) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def speaking_features(rows: list, y: np.ndarray) -> np.ndarray:
    """All features that occur clearly more often in positive texts, strongest first."""
    pos, neg = np.zeros(DIMS), np.zeros(DIMS)
    for r, positive in zip(rows, y):
        (pos if positive else neg)[r["f"]] += 1
    n_pos, n_neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    a, b = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    odds = np.log(a / b)
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    good = np.flatnonzero((odds > 1.5) & (z > 2.5) & (pos >= 4))
    return good[np.argsort(-z[good], kind="stable")]


class Chain:
    """Weights of the chain: ``text`` (features, categories), ``earlier`` (categories, categories), intercepts."""

    def __init__(self, names: list, text: np.ndarray, earlier: np.ndarray, bias: np.ndarray):
        self.names, self.text, self.earlier, self.bias = names, text, earlier, bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.names))
        for c in range(len(self.names)):
            out[c] = _sigmoid(scores[c] + self.bias[c] + self.earlier[c, :c] @ _logit(out[:c]))
        return out


def fit_chain(rows: list, names: list, targets: np.ndarray, kept: np.ndarray, folds: int = FOLDS) -> Chain:
    """Train the chain; ``targets`` is (rows, categories) of 0 and 1, in chain order."""
    place = np.full(DIMS, -1)
    place[kept] = np.arange(len(kept))
    row = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    col = place[np.concatenate([r["f"] for r in rows])]
    value = np.concatenate([r["v"] for r in rows]).astype(float)
    known = col >= 0
    x = Features(row[known], col[known], value[known], len(kept), np.zeros((len(rows), 0)))
    fold = np.arange(len(rows)) % folds
    n, c_all = len(rows), len(names)
    text, links, bias = np.zeros((DIMS, c_all)), np.zeros((c_all, c_all)), np.zeros(c_all)
    for c in range(c_all):
        unseen = np.zeros(n)
        for k in range(folds):
            out = fold == k
            if out.any() and (~out).any():
                unseen[out] = _apply(_fit(x.of(~out), targets[~out, c]), x.of(out))
        w = _fit(x, targets[:, c])
        text[kept, c] = w[:len(kept)]
        links[c, :c] = w[len(kept):len(kept) + c]
        bias[c] = w[-1]
        x = x.beside(_logit(unseen)[:, None])             # out-of-fold log-odds
    return Chain(names, text, links, bias)


#: The chain's categories: how much evidence a toxic text holds, then toxicity itself.
CATEGORIES = ["dense", "repeated", "toxic"]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Chain:
    """A chain trained on at most ``sample`` labelled rows.

    One graded label is known, ``label_col``. The two severity categories are
    derived from it: toxic texts whose count of speaking features lies
    above the median (dense) or above the lower quartile (repeated) of toxic texts.
    """
    wanted = labelled_sample(labels, id_col, [F.col(label_col).cast("int").alias("y")], sample)
    rows = sample_rows(docs, wanted, ["y"], text_features, id_col, text_col)
    if not rows:
        return Chain(CATEGORIES, np.zeros((DIMS, 3)), np.zeros((3, 3)), np.full(3, -9.0))
    y = np.array([r["y"] > 0 for r in rows], float)
    order = np.random.default_rng(11).permutation(len(rows))
    rows, y = [rows[i] for i in order], y[order]
    kept = speaking_features(rows, y)
    strong = np.zeros(DIMS, np.float32)
    strong[kept] = 1
    hits = np.array([float(strong[r["f"]] @ r["v"]) for r in rows])
    low, mid = (np.quantile(hits[y > 0], [0.25, 0.5]) if y.any() else (0, 0))
    targets = np.stack([y * (hits > mid), y * (hits > low), y], axis=1)
    return fit_chain(rows, CATEGORIES, targets, kept)


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., toxic) for every row; toxic: the last probability is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def run(batches):
        model = shared.value
        scores = WordScores(word_features, model.text)
        for b in batches:
            p = np.array([model.probabilities(scores.total(list(set(words(t or b""))))) for t in byte_rows(b.column("text"))])
            p = p.reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, i]) for i in range(len(names))), pa.array(p[:, -1] >= 0.5)],
                                             names=["doc_id", *names, "toxic"])

    held = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return held.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")
