"""Queries: the word-order language model and sparse TF-IDF vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.operators.language_model import BigramLM, ordered_perplexity
from selecta.operators.strategies import top_n
from selecta.operators.tfidf import TfIdf, centroid_cosines, cosines, sparse_centroids
from selecta.plans.registry import query
from selecta.plans.sqlbits import PREDS, tok, with_
from selecta.sources.tables import read_table
from selecta.sources.views import pairs, preds

SEED = 2021
TASK = "Represent the document for clustering:"
_BLANK = f"CASE WHEN len({tok('coalesce(pred, {q}{q})'.format(q=chr(39)))}) = 0 THEN 'dummy string' ELSE pred END"
_GRAMS = "unnest(list_transform(range(1, len(t) + 1), lambda i: {'u': CASE WHEN i = 1 THEN '' ELSE t[i - 1] END, 'w': t[i]}))"

ORDERED_SQL = with_(PREDS, f"""
gr AS (SELECT g.u AS u, g.w AS w, count(*) AS c FROM (SELECT {_GRAMS} AS g FROM (SELECT {tok("coalesce(text, '')")} AS t FROM documents)) GROUP BY 1, 2),
cx AS (SELECT u, sum(c) AS cu, count(*) AS followers FROM gr GROUP BY 1),
wd AS (SELECT w, count(*) AS before FROM gr GROUP BY 1),
tl AS (SELECT sum(before) AS b, count(*) AS v FROM wd),
pg AS (SELECT row_id, g.u AS u, g.w AS w, count(*) AS cnt
       FROM (SELECT row_id, {_GRAMS} AS g FROM (SELECT row_id, {tok(_BLANK)} AS t FROM preds WHERE seed = {SEED})) GROUP BY ALL),
qq AS (SELECT row_id, cnt, c, cu, followers,
              (greatest(coalesce(before, 0) - 0.75::DOUBLE, 0::DOUBLE) + 0.75::DOUBLE * v / (v + 1)) / b AS q
       FROM pg LEFT JOIN gr USING (u, w) LEFT JOIN cx USING (u) LEFT JOIN wd USING (w), tl),
lp AS (SELECT row_id, cnt, CASE WHEN cu IS NULL THEN q
              ELSE (greatest(coalesce(c, 0) - 0.75::DOUBLE, 0::DOUBLE) + 0.75::DOUBLE * followers * q) / cu END AS p FROM qq),
pp AS (SELECT row_id, round(exp(-(sum(CAST(round(ln(p) * 1e9) AS BIGINT) * cnt) / 1e9) / sum(cnt)), 6) AS perp FROM lp GROUP BY 1)
""")


def ordered_scores(spark, sf_dir):
    """(row_id, perp) of the predictions of one run under the bigram model of all documents."""
    lm = BigramLM.fit(read_table(spark, sf_dir, "documents"), "text")
    return ordered_perplexity(preds(spark, sf_dir).filter(F.col("seed") == SEED), lm, "pred", ["row_id"])


@query("ordered_perplexity", oracle=ORDERED_SQL + "SELECT row_id, perp FROM pp")
def q_ordered_perplexity(spark, sf_dir):
    """M3 with word order: interpolated Kneser-Ney bigrams."""
    return ordered_scores(spark, sf_dir)


@query("perp_ordered_low", oracle=ORDERED_SQL + """
SELECT p.row_id, p.instruction, p.input, p.output, pp.perp FROM pairs p JOIN pp USING (row_id) ORDER BY pp.perp, p.row_id LIMIT 50""")
def q_perp_ordered_low(spark, sf_dir):
    """X3 `perp` under the bigram model."""
    scored = pairs(spark, sf_dir).join(ordered_scores(spark, sf_dir), "row_id")
    return top_n(scored, "perp", 50, ascending=True).select("row_id", "instruction", "input", "output", "perp")


def _idf(text: str) -> str:
    """Document frequencies of the documents, and their number."""
    return f"""
tf AS (SELECT doc_id AS row_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({tok(f"coalesce({text}, '')")}) AS token FROM documents) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
nn AS (SELECT count(*) AS n FROM documents)"""


def _units(name: str, tf: str, key: str) -> str:
    """Unit vectors in long form of the term counts ``tf``."""
    return f"""
{name}_w AS (SELECT {key}, token, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM {tf} LEFT JOIN df USING (token), nn),
{name}_n AS (SELECT {key}, sqrt(CAST(sum(CAST(round(w * w * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12) AS norm FROM {name}_w GROUP BY {key}),
{name} AS (SELECT {key}, token, w / norm AS weight FROM {name}_w JOIN {name}_n USING ({key}))"""


def _encoded(text: str) -> str:
    return with_(_idf(text), _units("un", "tf", "row_id")) + """
, ve AS (SELECT row_id, list(token ORDER BY token) AS terms, list(round(weight, 6) ORDER BY token) AS weights FROM un GROUP BY 1)
SELECT doc_id AS row_id, coalesce(terms, []) AS terms, coalesce(weights, []) AS weights FROM documents LEFT JOIN ve ON row_id = doc_id"""


def _rounded(vectors):
    return vectors.select("row_id", "terms", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"))


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id")


@query("encode_tfidf", oracle=_encoded("text"))
def q_encode_tfidf(spark, sf_dir):
    """M1: sparse TF-IDF vectors of all documents."""
    docs = _documents(spark, sf_dir)
    return _rounded(TfIdf.fit(docs, ["row_id"]).encode(docs, ["row_id"], "text"))


@query("encode_task_tfidf", oracle=_encoded(f"'{TASK} ' || text"))
def q_encode_task_tfidf(spark, sf_dir):
    """M2: the same after a task description."""
    docs = _documents(spark, sf_dir)
    return _rounded(TfIdf.fit(docs, ["row_id"], task=TASK).encode(docs, ["row_id"], "text"))


_PREDICTED = ", ".join(
    f"{n} AS (SELECT k, token, count(*) AS tf FROM (SELECT row_id * 10000 + seed AS k, unnest({tok(f'coalesce({c}, {chr(39) * 2})')}) AS token FROM preds) GROUP BY 1, 2)"
    for n, c in (("tp", "pred"), ("tg", "gt")))


@query("cosine_tfidf", oracle=with_(PREDS, _idf("text"), _PREDICTED, _units("up", "tp", "k"), _units("ug", "tg", "k")) + """
, dots AS (SELECT k, CAST(sum(CAST(round(up.weight * ug.weight * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12 AS d FROM up JOIN ug USING (k, token) GROUP BY 1)
SELECT row_id, seed, round(coalesce(d, 0), 6) AS cosine FROM preds LEFT JOIN dots ON k = row_id * 10000 + seed""")
def q_cosine_tfidf(spark, sf_dir):
    """E5 over M1's sparse vectors: cosine of every prediction with its truth, idf of the documents."""
    model = TfIdf.fit(_documents(spark, sf_dir), ["row_id"])
    p, keys = preds(spark, sf_dir), ["row_id", "seed"]
    return cosines(p, keys, model.units(p, keys, "pred"), model.units(p, keys, "gt")).withColumn("cosine", F.round("cosine", 6))


@query("centroid_tfidf", oracle=with_(_idf("text"), _units("un", "tf", "row_id")) + """
, la AS (SELECT doc_id AS row_id, coalesce(lang, 'und') AS lang FROM documents),
sz AS (SELECT lang, count(*) AS n FROM la GROUP BY 1),
ce AS (SELECT lang, token, CAST(sum(CAST(round(weight * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12 / any_value(n) AS c
       FROM un JOIN la USING (row_id) JOIN sz USING (lang) GROUP BY 1, 2),
cn AS (SELECT lang, sqrt(CAST(sum(CAST(round(c * c * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12) AS norm FROM ce GROUP BY 1)
SELECT row_id, lang, round(CAST(sum(CAST(round(weight * (c / norm) * 1e12) AS HUGEINT)) AS DOUBLE) / 1e12, 6) AS cosine
FROM un JOIN la USING (row_id) JOIN ce USING (lang, token) JOIN cn USING (lang) GROUP BY 1, 2""")
def q_centroid_tfidf(spark, sf_dir):
    """F3 / A7 over sparse vectors: cosine of each document with the centroid of its language."""
    docs = _documents(spark, sf_dir).withColumn("lang", F.coalesce("lang", F.lit("und")))
    entries = TfIdf.fit(docs, ["row_id"]).units(docs, ["row_id", "lang"], "text")
    centers = sparse_centroids(entries, "lang", docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    return centroid_cosines(entries, ["row_id", "lang"], "lang", centers).withColumn("cosine", F.round("cosine", 6))
