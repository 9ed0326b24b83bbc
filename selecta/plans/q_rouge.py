"""Queries: ROUGE per prediction pair, and the ROUGE-based strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.functions.rouge import rouge_l, rouge_n
from selecta.operators.features import attach
from selecta.operators.strategies import combined_filter, top_n
from selecta.plans.q_features import PERP_SEED, PERP_SQL, perp_table
from selecta.plans.registry import query
from selecta.plans.sqlbits import PREDS, ROUGE_L, ngr, recursive, with_
from selecta.sources.views import pairs, preds


def _rouge_sql(n: int) -> str:
    return with_(PREDS, f"""
s AS (SELECT row_id, seed, pred, gt, list_distinct({ngr("coalesce(pred, '')", n)}) AS h,
             list_distinct({ngr("coalesce(gt, '')", n)}) AS g FROM preds),
c AS (SELECT row_id, seed, length(coalesce(pred, '')) > 0 AND length(coalesce(gt, '')) > 0 AS valid,
             CAST(len(list_intersect(h, g)) AS DOUBLE) AS i, len(h) AS lh, len(g) AS lg FROM s),
pr AS (SELECT row_id, seed, valid, CASE WHEN lh > 0 THEN i / lh ELSE 0.0 END AS p,
              CASE WHEN lg > 0 THEN i / lg ELSE 0.0 END AS r FROM c)
""") + """SELECT row_id, seed,
  round(CASE WHEN valid AND p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f,
  round(CASE WHEN valid THEN p ELSE 0.0 END, 6) AS p, round(CASE WHEN valid THEN r ELSE 0.0 END, 6) AS r FROM pr"""


def _rouge_cols(s):
    return [F.round(s["f"], 6).alias("f"), F.round(s["p"], 6).alias("p"), F.round(s["r"], 6).alias("r")]


@query("rouge1_pairs", oracle=_rouge_sql(1))
def q_rouge1(spark, sf_dir):
    """E2 + J1: ROUGE-1 f/p/r per (row_id, seed)."""
    p = preds(spark, sf_dir)
    return p.select("row_id", "seed", rouge_n(F.col("pred"), F.col("gt"), 1).alias("s")) \
        .select("row_id", "seed", *_rouge_cols(F.col("s")))


@query("rouge2_pairs", oracle=_rouge_sql(2))
def q_rouge2(spark, sf_dir):
    """ROUGE-2 f/p/r per (row_id, seed)."""
    p = preds(spark, sf_dir)
    return p.select("row_id", "seed", rouge_n(F.col("pred"), F.col("gt"), 2).alias("s")) \
        .select("row_id", "seed", *_rouge_cols(F.col("s")))


@query("rougel_pairs", oracle=recursive(with_(PREDS, ROUGE_L)) + "SELECT row_id, seed, round(f, 6) AS f, round(p, 6) AS p, round(r, 6) AS r FROM rl")
def q_rougel(spark, sf_dir):
    """ROUGE-L f/p/r per pair (bit-parallel LCS in Arrow batches)."""
    p = preds(spark, sf_dir)
    return p.select("row_id", "seed", rouge_l(F.col("pred"), F.col("gt")).alias("s")) \
        .select("row_id", "seed", *_rouge_cols(F.col("s")))


def rouge_feature(spark, sf_dir):
    """Per row: ROUGE-L f of the seed-2021 prediction against its truth."""
    p = preds(spark, sf_dir).filter(F.col("seed") == PERP_SEED)
    return p.select("row_id", F.round(rouge_l(F.col("pred"), F.col("gt"))["f"], 6).alias("rouge"))


@query("rouge_feature_top", oracle=recursive(with_(PREDS, ROUGE_L)) + f"""
SELECT row_id, instruction, input, output, round(f, 6) AS rouge FROM pairs JOIN (SELECT * FROM rl WHERE seed = {PERP_SEED}) USING (row_id)
ORDER BY round(f, 6) DESC, row_id LIMIT 50""")
def q_rouge_feature_top(spark, sf_dir):
    """The n rows whose prediction scores the highest ROUGE-L."""
    f = attach(pairs(spark, sf_dir), rouge_feature(spark, sf_dir))
    return top_n(f, "rouge", 50, ascending=False).select("row_id", "instruction", "input", "output", "rouge")


@query("combined_filter", oracle=recursive(PERP_SQL) + "," + ROUGE_L + f"""
SELECT row_id, instruction, input, output, perp, round(f, 6) AS rouge FROM fe JOIN (SELECT * FROM rl WHERE seed = {PERP_SEED}) USING (row_id)
WHERE perp > 0.3 AND round(f, 6) > 0.005 AND round(f, 6) < 0.7 ORDER BY row_id LIMIT 50""")
def q_combined_filter(spark, sf_dir):
    """Perp > 0.3 and 0.005 < rouge < 0.7, first n by row_id."""
    feats = attach(perp_table(spark, sf_dir), rouge_feature(spark, sf_dir))
    return combined_filter(feats, 50).select("row_id", "instruction", "input", "output", "perp", "rouge")
