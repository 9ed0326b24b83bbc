"""Queries: evaluation of predictions per seed and averaged over seeds (E3 flow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.functions.rouge import rouge_l, rouge_n
from selecta.operators.evaluate import bow_cosine, matched_pairs, seed_average
from selecta.operators.features import UnigramLM, perplexity
from selecta.plans.registry import query
from selecta.plans.sqlbits import PREDS, ROUGE_L, recursive, tok, with_
from selecta.sources.tables import read_table
from selecta.sources.views import pairs, preds

COS_SQL = with_(PREDS, f"""
ta AS (SELECT row_id, seed, t AS token, count(*) AS ca FROM (SELECT row_id, seed, unnest({tok("coalesce(pred, '')")}) AS t FROM preds) GROUP BY ALL),
tb AS (SELECT row_id, seed, t AS token, count(*) AS cb FROM (SELECT row_id, seed, unnest({tok("coalesce(gt, '')")}) AS t FROM preds) GROUP BY ALL),
j AS (SELECT coalesce(ta.row_id, tb.row_id) AS row_id, coalesce(ta.seed, tb.seed) AS seed,
             coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
      FROM ta FULL JOIN tb ON ta.row_id = tb.row_id AND ta.seed = tb.seed AND ta.token = tb.token),
sm AS (SELECT row_id, seed, sum(ca * cb) AS dot, sum(ca * ca) AS na, sum(cb * cb) AS nb FROM j GROUP BY ALL),
cs AS (SELECT p.row_id, p.seed, coalesce(CASE WHEN na > 0 AND nb > 0 THEN CAST(dot AS DOUBLE) / sqrt(CAST(na AS DOUBLE) * CAST(nb AS DOUBLE)) ELSE 0.0 END, 0.0) AS cosine
       FROM preds p LEFT JOIN sm USING (row_id, seed))
""")


@query("cosine_diag", oracle=COS_SQL + "SELECT row_id, seed, round(cosine, 4) AS cosine FROM cs")
def q_cosine_diag(spark, sf_dir):
    """J6 + E5 + E11: cosine of each prediction with its own truth, rounded to 4."""
    return preds(spark, sf_dir).select("row_id", "seed", F.round(bow_cosine("pred", "gt"), 4).alias("cosine"))


EVAL_SQL = COS_SQL + f"""
, h AS (SELECT row_id, seed, pred, gt, list_distinct({tok("coalesce(pred, '')")}) AS hh,
               list_distinct({tok("coalesce(gt, '')")}) AS gg FROM preds),
pr AS (SELECT row_id, seed, length(coalesce(pred, '')) > 0 AND length(coalesce(gt, '')) > 0 AS valid,
              CASE WHEN len(hh) > 0 THEN len(list_intersect(hh, gg)) / len(hh) ELSE 0.0 END AS p,
              CASE WHEN len(gg) > 0 THEN len(list_intersect(hh, gg)) / len(gg) ELSE 0.0 END AS r FROM h),
r1 AS (SELECT row_id, seed, CASE WHEN valid AND p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM pr),
lm AS (SELECT t AS token, count(*) AS c FROM (SELECT unnest({tok("coalesce(text, '')")}) AS t FROM documents) GROUP BY 1),
tot AS (SELECT sum(c) AS tt, count(*) + 1 AS vv FROM lm),
x AS (SELECT row_id, seed, unnest({tok("CASE WHEN len(" + tok("coalesce(pred, '')") + ") = 0 THEN 'dummy string' ELSE pred END")}) AS token FROM preds),
per AS (SELECT row_id, seed, token, count(*) AS cnt FROM x GROUP BY ALL),
ss AS (SELECT row_id, seed, sum(CAST(round(ln((coalesce(c, 0) + 1.0) / (tt + 1.0 * vv)) * 1e9) AS BIGINT) * cnt) AS s,
              sum(cnt) AS n FROM per LEFT JOIN lm USING (token), tot GROUP BY ALL),
pp AS (SELECT row_id, seed, round(exp(-(s / 1e9) / n), 6) AS perp FROM ss),
by_seed AS (
  SELECT seed, round(avg(r1.f), 6) AS rouge1_f, round(avg(round(cs.cosine, 4)), 6) AS cosine, round(avg(pp.perp), 2) AS perplexity
  FROM r1 JOIN cs USING (row_id, seed) JOIN pp USING (row_id, seed) GROUP BY seed)
"""


def pair_metrics(spark, sf_dir):
    """(row_id, seed, rouge1_f, rougeL_f, cosine, perp): the scores of every pair.

    ROUGE and cosine need a pair's own texts only; perplexity joins the corpus vocabulary.
    """
    p = preds(spark, sf_dir)
    keys = ["row_id", "seed"]
    own = p.select(*keys, rouge_n(F.col("pred"), F.col("gt"), 1)["f"].alias("rouge1_f"),
                   rouge_l(F.col("pred"), F.col("gt"))["f"].alias("rougeL_f"), F.round(bow_cosine("pred", "gt"), 4).alias("cosine"))
    lm = UnigramLM.fit(read_table(spark, sf_dir, "documents"), "text")
    return own.join(perplexity(p, lm, "pred", keys), keys)


def eval_by_seed(spark, sf_dir):
    return pair_metrics(spark, sf_dir).groupBy("seed").agg(
        F.round(F.avg("rouge1_f"), 6).alias("rouge1_f"), F.round(F.avg("cosine"), 6).alias("cosine"),
        F.round(F.avg("perp"), 2).alias("perplexity"))


@query("eval_by_seed", oracle=EVAL_SQL + "SELECT * FROM by_seed")
def q_eval_by_seed(spark, sf_dir):
    """A13-A15 + J1: per seed: mean ROUGE-1 F, mean rounded cosine, mean perplexity."""
    return eval_by_seed(spark, sf_dir)


@query("eval_mean", oracle=EVAL_SQL + """
SELECT round(avg(rouge1_f), 6) AS rouge1_f, round(avg(cosine), 6) AS cosine, round(avg(perplexity), 2) AS perplexity FROM by_seed""")
def q_eval_mean(spark, sf_dir):
    """Equal-weight mean over the three seeds."""
    s = seed_average(eval_by_seed(spark, sf_dir), [], ["rouge1_f", "cosine", "perplexity"])
    return s.select(F.round("rouge1_f", 6).alias("rouge1_f"), F.round("cosine", 6).alias("cosine"),
                    F.round("perplexity", 2).alias("perplexity"))


@query("eval_rougel", oracle=recursive(with_(PREDS, ROUGE_L)) + """
, bs AS (SELECT seed, round(avg(f), 6) AS "rougeL_f" FROM rl GROUP BY seed)
SELECT seed, "rougeL_f" FROM bs UNION ALL SELECT NULL, round(avg("rougeL_f"), 6) FROM bs""")
def q_eval_rougel(spark, sf_dir):
    """A13 with ROUGE-L F (the reference's headline metric) per seed and averaged."""
    per = preds(spark, sf_dir).select("seed", rouge_l(F.col("pred"), F.col("gt"))["f"].alias("f"))
    by_seed = per.groupBy("seed").agg(F.round(F.avg("f"), 6).alias("rougeL_f"))
    mean = by_seed.agg(F.lit(None).cast("int").alias("seed"), F.round(F.avg("rougeL_f"), 6).alias("rougeL_f"))
    return by_seed.unionByName(mean)


#: Evaluation sets of the cross table: the conversations dealt into three.
EVAL_SETS = 3


@query("eval_cross", oracle=recursive(EVAL_SQL) + "," + ROUGE_L + f"""
SELECT seed AS train_set, CAST((row_id // 100) % {EVAL_SETS} AS INTEGER) AS eval_set, round(avg(rl.f), 6) AS "rougeL_f",
       round(avg(round(cs.cosine, 4)), 6) AS cosine, round(avg(pp.perp), 2) AS perplexity, CAST(count(*) AS BIGINT) AS n_pairs
FROM rl JOIN cs USING (row_id, seed) JOIN pp USING (row_id, seed) GROUP BY ALL""")
def q_eval_cross(spark, sf_dir):
    """Each run's predictions against the truths of each evaluation set, aligned by
    key: mean ROUGE-L, cosine and perplexity per (train_set, eval_set)."""
    m = pair_metrics(spark, sf_dir).select(
        F.col("seed").alias("train_set"), (F.floor(F.col("row_id") / 100) % EVAL_SETS).cast("int").alias("eval_set"), "rougeL_f", "cosine", "perp")
    return m.groupBy("train_set", "eval_set").agg(
        F.round(F.avg("rougeL_f"), 6).alias("rougeL_f"), F.round(F.avg("cosine"), 6).alias("cosine"),
        F.round(F.avg("perp"), 2).alias("perplexity"), F.count(F.lit(1)).alias("n_pairs"))


@query("eval_unmatched", oracle="""
WITH p AS (SELECT conv_id * 1000000 + turn - 1 AS row_id FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id * 1000000 + turn AS row_id FROM conversations WHERE role = 'user')
SELECT CASE WHEN p.row_id IS NULL THEN 'truth' WHEN t.row_id IS NULL THEN 'prediction' ELSE 'both' END AS match, count(*) AS n
FROM p FULL JOIN t ON p.row_id = t.row_id GROUP BY ALL""")
def q_eval_unmatched(spark, sf_dir):
    """J1 (Q24): every user turn and every answer, aligned by the answer's place right after
    its turn; how many match and how many do not."""
    c = read_table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1_000_000 + F.col("turn")
    answers = c.filter(F.col("role") == "assistant").select((key - 1).alias("row_id"), F.col("text").alias("pred"))
    turns = c.filter(F.col("role") == "user").select(key.alias("row_id"), F.col("text").alias("output"))
    return matched_pairs(answers, turns).groupBy("match").agg(F.count(F.lit(1)).alias("n"))
