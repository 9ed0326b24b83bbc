"""Operator 3: hierarchical language identification.

A softmax regression over character n-grams predicts the language's family;
within the family, one linear support vector machine for each pair of
languages votes, and the most votes win (ties: larger summed margin, then name).

Features are hashed: each word, lower-cased, gives itself and its character
1- to 3-grams with its borders; a text's features are means over its words.

Plan: a bounded sample of training rows (``quota`` a language in expectation, by hash) trains on the
driver; one matrix of weights, with a column for each family and pair, is broadcast; all
texts are scored where they lie, without a shuffle.

Defined results: ``und`` with score 0 for a null text, a text without letters, or
when nothing could be learned. Repeated rows give one row each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from selecta.llm.common import byte_rows, texts
from selecta.llm.hashed_text import Buckets, WordScores, adam, bucket, counted, dense, sample_rows

DIMS = 4_096
QUOTA = 700

#: Families of languages. Fixed values; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
}
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


_BUCKETS = Buckets(DIMS)


def word_features(word: bytes) -> list:
    w = "\x02" + word.decode("utf-8", "replace").lower() + "\x03"
    grams = [w[i:i + n] for n in (2, 3) for i in range(len(w) - n + 1)]
    return [bucket(w, DIMS), *map(_BUCKETS.__getitem__, w), *map(_BUCKETS.__getitem__, grams)]


def text_features(text: bytes | None) -> tuple:
    words = (text or b"").split()
    f, v = counted(words, word_features)
    return f, [x / max(1, len(words)) for x in v]


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


class Model:
    """``weights`` (DIMS, families + pairs) and ``bias``; pairs are (language, language) of one family."""

    def __init__(self, families: list, members: dict, pairs: list, weights: np.ndarray, bias: np.ndarray):
        self.families, self.members, self.pairs, self.weights, self.bias = families, members, pairs, weights, bias

    def predict(self, scores: np.ndarray) -> tuple[str, float]:
        s = scores + self.bias
        n = len(self.families)
        e = np.exp(s[:n] - s[:n].max())
        p = e / e.sum()
        best = int(p.argmax())
        langs = self.members[self.families[best]]
        votes = {lang: [0, 0.0] for lang in langs}
        sure = {lang: [] for lang in langs}
        for (a, b), margin in zip(self.pairs, s[n:]):
            if a in votes and b in votes:
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += margin
                votes[b][1] -= margin
                q = 1.0 / (1.0 + np.exp(-np.clip(2 * margin, -30, 30)))
                sure[a].append(q)
                sure[b].append(1 - q)
        lang = min(langs, key=lambda x: (-votes[x][0], -votes[x][1], x))
        return lang, float(p[best] * (np.mean(sure[lang]) if sure[lang] else 1.0))


def _softmax_fit(x, y, n, steps=200, l2=1e-3):
    hot = np.eye(n, dtype=np.float32)[y]

    def gradient(u):
        w = u.reshape(-1, n)
        s = x @ w[:-1] + w[-1]
        e = np.exp(s - s.max(1, keepdims=True))
        d = ((e / e.sum(1, keepdims=True) - hot) / len(x)).astype(np.float32)
        g = np.concatenate([x.T @ d, d.sum(0, keepdims=True)])
        g[:-1] += l2 * w[:-1]
        return g.ravel()

    return adam(gradient, np.zeros((x.shape[1] + 1) * n), steps, 0.05).reshape(-1, n)


def _svm_fit(x, y, steps=200, l2=1e-3):
    """Linear support vector machine with squared hinge loss; y is +1 or -1."""
    def gradient(u):
        short = np.maximum(0, 1 - y * (x @ u[:-1] + u[-1]))
        d = (-2 * y * short / len(x)).astype(np.float32)
        return np.concatenate([x.T @ d + l2 * u[:-1], [d.sum()]])

    return adam(gradient, np.zeros(x.shape[1] + 1), steps, 0.05)


def training_rows(sampled: DataFrame, most: int = 4 * 4 * QUOTA) -> DataFrame:
    """(doc_id, lang) of at most ``most`` rows of (doc_id, lang, unit): the first of every language by
    ``unit``, then the second ones, and so on."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "doc_id"))
    return sampled.withColumn("_nth", nth).orderBy("_nth", "unit", "doc_id", "lang").limit(most).select("doc_id", "lang").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", quota: int = QUOTA) -> Model | None:
    """A model from (expected) ``quota`` rows of each language of ``docs``; None without any.

    Rows are taken by the hash of their id, at a rate set by the language's count.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = held.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return None
    quota = min(quota, max(50, 4 * QUOTA // languages))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rates = counts.select("lang", F.least(F.lit(1.0), quota / F.col("count")).alias("rate"))
    wanted = training_rows(held.select("doc_id", "lang", unit.alias("unit")).join(F.broadcast(rates), "lang").filter("unit < rate"))
    rows = [r for r in sample_rows(held.drop("lang"), wanted, ["lang"], text_features) if len(r["f"])]
    if not rows:
        return None
    x = dense(rows, DIMS)
    mean, spread = x.mean(0), x.std(0) + np.float32(0.02)
    x = (x - mean) / spread / np.float32(8)
    lang = np.array([r["lang"] for r in rows])
    members: dict = {}
    for name in sorted(set(lang.tolist())):
        members.setdefault(family_of(name), []).append(name)
    families = sorted(members)
    pairs = [(a, b) for f in families for i, a in enumerate(members[f]) for b in members[f][i + 1:]]
    columns = []
    own = np.array([families.index(family_of(v)) for v in lang])
    columns += list(_softmax_fit(x, own, len(families)).T)
    for a, b in pairs:
        some = (lang == a) | (lang == b)
        columns.append(_svm_fit(x[some], np.where(lang[some] == a, 1.0, -1.0)))
    w = np.stack(columns, axis=1)
    scaled = w[:-1] / spread[:, None] / 8
    return Model(families, members, pairs, scaled, w[-1] - mean @ scaled)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = shared.value
        scores = WordScores(word_features, held.weights) if held else None
        for b in batches:
            out = []
            for text in byte_rows(b.column("text")):
                if held is None or not has_letter(text):
                    out.append(("und", 0.0))
                else:
                    words = text.split()
                    out.append(held.predict(scores.total(words) / len(words)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([a for a, _ in out], pa.string()),
                                              pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
