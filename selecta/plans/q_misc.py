"""Queries: packing (W6), resume (S16), sample grouping (M5), PCA map (M6),
selector-constant lookup (P22), reciprocal score and meta vector (P20, P21)."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from selecta.functions.text import template_infer, template_train, tokens
from selecta.operators.pack import pack_sequences
from selecta.operators.features import attach
from selecta.plans.q_features import PERP_SQL, perp_table
from selecta.plans.q_rouge import rouge_feature
from selecta.plans.registry import query
from selecta.plans.sqlbits import MULTI, PAIRS, PREDS, ROUGE_L, recursive, tok, with_
from selecta.sources.views import multi, pairs, preds
from selecta.streaming.resume import group_samples, pending

SHARD_ROWS = 64
TRAIN_SQL_Q = ("'### Instruction:' || chr(10) || coalesce(instruction, '') || chr(10) || chr(10) || '### Input:' || chr(10) "
               "|| coalesce(input, '') || chr(10) || chr(10) || '### Response:' || chr(10) || coalesce(output, '') || chr(10)")


@query("pack_sequences", oracle=with_(PAIRS) + f"""
, t AS (SELECT row_id, md5(concat('2023', ':', CAST(row_id AS VARCHAR))) AS k,
               CAST(len({tok(TRAIN_SQL_Q)}) + 1 AS BIGINT) AS n_tokens FROM pairs),
s AS (SELECT *, CAST(ceil((SELECT count(*) FROM pairs) / {SHARD_ROWS}.0) AS BIGINT) AS ns FROM t),
u AS (SELECT row_id, CAST(CAST(('0x' || substr(k, 1, 8)) AS BIGINT) % ns AS INTEGER) AS shard, k, n_tokens FROM s),
w AS (SELECT *, sum(n_tokens) OVER (PARTITION BY shard ORDER BY k, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM u)
SELECT row_id, shard, CAST(unnest(range(CAST(floor((e - n_tokens) / 4096) AS BIGINT), CAST(floor((e - 1) / 4096) AS BIGINT) + 1)) AS BIGINT) AS block,
       n_tokens, CAST(e - n_tokens AS BIGINT) AS start FROM w""")
def q_pack_sequences(spark, sf_dir):
    """Training texts packed into 4,096-token blocks per seeded shard."""
    p = pairs(spark, sf_dir)
    t = p.select("row_id", template_train("instruction", "input", "output").alias("text"))
    n = p.count()
    return pack_sequences(t, "text", shards=max(1, math.ceil(n / SHARD_ROWS))) \
        .select("row_id", "shard", "block", "n_tokens", "start")


@query("resume_pending", oracle=with_(PREDS) + """
, done AS (SELECT row_id FROM preds WHERE seed = 2021 AND len(""" + tok("pred") + """) >= 50)
SELECT row_id, md5(""" + ("'### Instruction:' || chr(10) || '            ' || coalesce(instruction, '') || chr(10) || chr(10) || "
                           "'            ' || '### Input:' || chr(10) || '            ' || coalesce(input, '') || chr(10) || chr(10) || "
                           "'            ' || '### Response:' || chr(10) || '            '") + """) AS prompt_md5
FROM pairs WHERE row_id NOT IN (SELECT row_id FROM done)""")
def q_resume_pending(spark, sf_dir):
    """Prompts still to generate = all prompts minus rows already written."""
    prompts = pairs(spark, sf_dir).select("row_id", template_infer("instruction", "input").alias("prompt"))
    # rows whose stored generation is already complete (>= 50 tokens) are done
    done = preds(spark, sf_dir).filter((F.col("seed") == 2021) & (F.size(tokens("pred")) >= 50))
    return pending(prompts, done).select("row_id", F.md5("prompt").alias("prompt_md5"))


@query("group_samples", oracle=with_(MULTI) + """
, s AS (SELECT row_id, unnest(generate_series(0, len(responses) - 1)) AS sample_no, unnest(responses) AS text FROM multi)
SELECT row_id, list(text ORDER BY sample_no) AS responses, count(*) AS n_samples FROM s GROUP BY row_id""")
def q_group_samples(spark, sf_dir):
    """M5 (Q22): generated samples (one row each) grouped back per prompt."""
    samples = multi(spark, sf_dir).select("row_id", F.posexplode("responses").alias("sample_no", "text"))
    return group_samples(samples)


@query("pca_2d")
def q_pca_2d(spark, sf_dir):
    """M6: 2-D map coordinates of the vectors (pyspark.ml PCA)."""
    from selecta.sources.views import points
    p = points(spark, sf_dir).select("row_id", array_to_vector("embedding").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(p)
    out = model.transform(p).select("row_id", vector_to_array(F.col("xy")).alias("xy"))
    return out.select("row_id", F.round(F.col("xy")[0], 6).alias("x"), F.round(F.col("xy")[1], 6).alias("y"))


@query("meta_vector", oracle=recursive(PERP_SQL) + "," + ROUGE_L + """
, lf AS (SELECT row_id, CAST(length(coalesce(input, '') || coalesce(instruction, '')) AS DOUBLE) AS raw FROM pairs),
mx AS (SELECT max(raw) AS m FROM lf)
SELECT fe.row_id, CASE WHEN fe.perp = 0 THEN NULL ELSE round(1.0 / fe.perp, 6) END AS inv_perp,
       [coalesce(CASE WHEN fe.perp = 0 THEN NULL ELSE round(1.0 / fe.perp, 6) END, 0.0),
        round(CASE WHEN m > 0 THEN raw / m ELSE 0.0 END, 6), round(rl.f, 6)] AS meta
FROM fe JOIN lf USING (row_id) JOIN (SELECT * FROM rl WHERE seed = 2021) rl USING (row_id), mx""")
def q_meta_vector(spark, sf_dir):
    """P20 + P21: reciprocal perplexity (NULL for 0 -> 0.0 in the vector) and
    the (perplexity, length, ROUGE-L) meta vector per row."""
    f = attach(perp_table(spark, sf_dir), rouge_feature(spark, sf_dir))
    raw = F.length(F.concat(F.coalesce("input", F.lit("")), F.coalesce("instruction", F.lit("")))).cast("double")
    f = f.withColumn("_raw", raw)
    mx = f.agg(F.max("_raw").alias("_m"))
    f = f.crossJoin(F.broadcast(mx))
    inv = F.when(F.col("perp") == 0, F.lit(None).cast("double")).otherwise(F.round(1.0 / F.col("perp"), 6))
    ln = F.round(F.when(F.col("_m") > 0, F.col("_raw") / F.col("_m")).otherwise(F.lit(0.0)), 6)
    return f.select("row_id", inv.alias("inv_perp"),
                    F.array(F.coalesce(inv, F.lit(0.0)), ln, F.col("rouge")).alias("meta"))
