"""Hashed word features and linear scores over them, for the classifiers.

A classifier's features are sums over a text's words, so a text's score is the
sum of its words' scores. Workers keep the scores of recent words and add them
up per text; a text is read whole, whatever its length.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selecta.llm.common import CACHE_WORDS, byte_rows, texts


def bucket(feature: str, dims: int) -> int:
    return zlib.crc32(feature.encode("utf-8")) % dims


class Buckets(dict):
    """feature -> bucket; a bounded cache in front of :func:`bucket`."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[feature] = bucket(feature, self.dims)
        return value


class WordScores(dict):
    """word -> row of ``table``, which holds the sums of the weights of the word's features."""

    def __init__(self, features: Callable[[bytes], Iterable[int]], weights: np.ndarray):
        super().__init__()
        self.features, self.weights = features, weights
        self.table = np.zeros((4096, weights.shape[1]))

    def _learn(self, words: list) -> None:
        """Score new words, all at once."""
        found = [list(self.features(w)) for w in words]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
        total = np.concatenate([np.zeros((1, self.weights.shape[1])), np.cumsum(self.weights[flat], axis=0)])
        ends = np.cumsum(sizes)
        first = len(self)
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first:first + len(words)] = total[ends] - total[ends - sizes]
        self.update(zip(words, range(first, first + len(words))))

    def rows(self, words: list) -> np.ndarray:
        """Rows of some words; the cache starts afresh between calls only."""
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = list(map(self.get, words))
        if None in got:
            self._learn(list({w: None for w, r in zip(words, got) if r is None}))
            got = list(map(self.get, words))
        return np.array(got, np.int64)

    def total(self, words: list) -> np.ndarray:
        """Sum of the words' scores."""
        out = np.zeros(self.weights.shape[1])
        for i in range(0, len(words), 1 << 18):
            rows = self.rows(words[i:i + (1 << 18)])
            out += self.table[rows].sum(axis=0)
        return out


def counted(words: list, features: Callable[[bytes], Iterable[int]], extra: Iterable = ()) -> tuple[list, list]:
    """(feature, sum) pairs of a text for training, and ``extra`` (feature, value) pairs."""
    total: Counter = Counter()
    for word, n in Counter(words).items():
        for f in features(word):
            total[f] += n
    for f, v in extra:
        total[f] += v
    return list(total.keys()), [float(v) for v in total.values()]


def sample_rows(docs: DataFrame, wanted: DataFrame, label_cols: list, features: Callable[[bytes | None], tuple],
                id_col: str = "doc_id", text_col: str = "text") -> list:
    """[{labels..., f: features, v: values}] of the documents named in ``wanted``.

    ``wanted`` (doc_id and label columns) is a sample whose size the caller has
    bounded; it is broadcast, and only its documents reach Python.
    """
    held = texts(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id").select("text", *label_cols)

    def run(batches):
        for b in batches:
            got = [features(t) for t in byte_rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in label_cols), pa.array([np.array(f, np.int32).tobytes() for f, _ in got], pa.binary()),
                 pa.array([np.array(v, np.float32).tobytes() for _, v in got], pa.binary())], names=[*label_cols, "f", "v"])

    kinds = dict(held.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in label_cols) + ", f binary, v binary"
    got = sorted(held.mapInArrow(run, schema).collect(), key=lambda r: (*(str(r[c]) for c in label_cols), bytes(r["f"]), bytes(r["v"])))
    return [{**{c: r[c] for c in label_cols}, "f": np.frombuffer(r["f"], np.int32), "v": np.frombuffer(r["v"], np.float32)} for r in got]


def dense(rows: list, dims: int) -> np.ndarray:
    """(rows, dims) matrix of sampled features."""
    out = np.zeros((len(rows), dims), np.float32)
    for i, r in enumerate(rows):
        out[i, r["f"]] = r["v"]
    return out


def adam(gradient: Callable[[np.ndarray], np.ndarray], w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam from ``w``, in single precision like the features."""
    w = w.astype(np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w).astype(np.float32)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w = w.astype(np.float32)
    return w.astype(float)


def labelled_sample(labels: DataFrame, id_col: str, cols: list, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``labels`` without nulls, least hash of the id first."""
    held = labels.select(F.col(id_col).alias("doc_id"), *cols).dropna()
    return held.orderBy(F.xxhash64("doc_id"), "doc_id", *cols).limit(bound)
