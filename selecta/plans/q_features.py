"""Queries: length, open-endedness, perplexity features and their strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from selecta.functions.text import tokens
from selecta.operators.features import UnigramLM, length_features, open_ended_scores, perplexity
from selecta.operators.strategies import middle_slice, top_n
from selecta.plans.registry import query
from selecta.plans.sqlbits import INSTR, MULTI, PREDS, tok, with_
from selecta.sources.tables import read_table
from selecta.sources.views import instr, multi, preds

N = 100
PERP_SEED = 2021

LENGTH_SQL = with_(INSTR, """
f AS (SELECT row_id, instruction, input, output,
             CAST(length(coalesce(input, '') || coalesce(instruction, '')) AS DOUBLE) AS raw FROM instr),
s AS (SELECT max(raw) AS mx, min(raw) AS mn FROM f),
g AS (SELECT f.*, CASE WHEN mx > 0 THEN raw / mx ELSE 0.0 END AS lengths,
             CASE WHEN mx > 0 THEN mn / mx ELSE 0.0 END AS lo, CASE WHEN mx > 0 THEN 1.0 ELSE 0.0 END AS hi FROM f, s),
h AS (SELECT *, CASE WHEN hi > lo THEN (lengths - lo) / (hi - lo) ELSE 0.0 END AS normalized_lengths FROM g)
""")


@query("length_scaled", oracle=LENGTH_SQL + """
SELECT row_id, round(lengths, 6) AS lengths, round(normalized_lengths, 6) AS normalized_lengths FROM h""")
def q_length_scaled(spark, sf_dir):
    """A10 + A11."""
    f = length_features(instr(spark, sf_dir))
    return f.select("row_id", F.round("lengths", 6).alias("lengths"),
                    F.round("normalized_lengths", 6).alias("normalized_lengths"))


@query("length_small", oracle=LENGTH_SQL + f"""
SELECT row_id, instruction, input, output FROM h ORDER BY normalized_lengths, row_id LIMIT {N}""")
def q_length_small(spark, sf_dir):
    """N shortest."""
    return top_n(length_features(instr(spark, sf_dir)), "normalized_lengths", N, ascending=True) \
        .select("row_id", "instruction", "input", "output")


@query("length_big", oracle=LENGTH_SQL + f"""
SELECT row_id, instruction, input, output FROM h ORDER BY normalized_lengths DESC, row_id LIMIT {N}""")
def q_length_big(spark, sf_dir):
    """N longest."""
    return top_n(length_features(instr(spark, sf_dir)), "normalized_lengths", N, ascending=False) \
        .select("row_id", "instruction", "input", "output")


OE_SQL = with_(MULTI, f"""
lns AS (SELECT row_id, unnest(responses) AS x FROM multi),
tks AS (SELECT row_id, {tok("x")} AS t FROM lns),
bgs AS (SELECT row_id, unnest(list_transform(list_zip(t[1:len(t) - 1], t[2:]), lambda z: z[1] || ' ' || z[2])) AS b FROM tks WHERE len(t) > 1),
nb AS (SELECT row_id, count(DISTINCT b) AS n FROM bgs GROUP BY 1),
oe AS (SELECT row_id, prompt, responses, CAST(coalesce(n, 0) AS BIGINT) AS n_unique_bigrams FROM multi LEFT JOIN nb USING (row_id)
       WHERE len(list_filter(responses, lambda x: length(x) = 0)) = 0)
""")


@query("open_ended_scores", oracle=OE_SQL + "SELECT row_id, n_unique_bigrams FROM oe")
def q_open_ended_scores(spark, sf_dir):
    """A12 + F2 + E1."""
    return open_ended_scores(multi(spark, sf_dir)).select("row_id", "n_unique_bigrams")


@query("open_ended_top", oracle=OE_SQL.replace("WITH ", "WITH " + INSTR[:0], 1) + f"""
, top AS (SELECT row_id, n_unique_bigrams FROM oe ORDER BY n_unique_bigrams DESC, row_id LIMIT {N}),
{INSTR}
SELECT i.row_id, i.instruction, i.input, i.output, t.n_unique_bigrams FROM top t JOIN instr i USING (row_id)""")
def q_open_ended_top(spark, sf_dir):
    """N most open-ended prompts, as instruction rows."""
    top = top_n(open_ended_scores(multi(spark, sf_dir)), "n_unique_bigrams", N, ascending=False) \
        .select("row_id", "n_unique_bigrams")
    return instr(spark, sf_dir).join(top, "row_id").select(
        "row_id", "instruction", "input", "output", "n_unique_bigrams")


@query("exemplar_report", oracle=OE_SQL + """
, best AS (SELECT 'best' AS side, row_number() OVER (ORDER BY n_unique_bigrams DESC, row_id) AS rk, * FROM oe),
worst AS (SELECT 'worst' AS side, row_number() OVER (ORDER BY n_unique_bigrams, row_id DESC) AS rk, * FROM oe)
SELECT side, CAST(rk AS INTEGER) AS rk, row_id, n_unique_bigrams, prompt, array_to_string(responses, '') AS answers
FROM (SELECT * FROM best WHERE rk <= 7 UNION ALL SELECT * FROM worst WHERE rk <= 6)""")
def q_exemplar_report(spark, sf_dir):
    """T7 (Q12): 7 most and 6 least open-ended prompts with their answers."""
    s = open_ended_scores(multi(spark, sf_dir))
    best = s.orderBy(F.desc("n_unique_bigrams"), "row_id").limit(7)
    worst = s.orderBy("n_unique_bigrams", F.desc("row_id")).limit(6)

    def label(df, side, order):
        # at most 7 rows: ranking them in one partition is bounded
        w = Window.orderBy(*order)
        return df.select(F.lit(side).alias("side"), F.row_number().over(w).cast("int").alias("rk"),
                         "row_id", "n_unique_bigrams", "prompt",
                         F.array_join("responses", "").alias("answers"))

    return label(best, "best", [F.desc("n_unique_bigrams"), "row_id"]).unionByName(
        label(worst, "worst", ["n_unique_bigrams", F.desc("row_id")]))


PERP_SQL = with_(PREDS, f"""
lm AS (SELECT t AS token, count(*) AS c FROM (SELECT unnest({tok("coalesce(text, '')")}) AS t FROM documents) GROUP BY 1),
tot AS (SELECT sum(c) AS tt, count(*) + 1 AS vv FROM lm),
x AS (SELECT row_id, unnest({tok(f"CASE WHEN len({tok('coalesce(pred, {q}{q})'.format(q=chr(39)))}) = 0 THEN 'dummy string' ELSE pred END")}) AS token
      FROM preds WHERE seed = {PERP_SEED}),
per AS (SELECT row_id, token, count(*) AS cnt FROM x GROUP BY 1, 2),
ss AS (SELECT row_id, sum(CAST(round(ln((coalesce(c, 0) + 1.0) / (tt + 1.0 * vv)) * 1e9) AS BIGINT) * cnt) AS s,
              sum(cnt) AS n
       FROM per LEFT JOIN lm USING (token), tot GROUP BY row_id),
pp AS (SELECT row_id, round(exp(-(s / 1e9) / n), 6) AS perp FROM ss),
fe AS (SELECT p.row_id, p.instruction, p.input, p.output, pp.perp FROM pairs p JOIN pp USING (row_id))
""")


def perp_table(spark, sf_dir):
    """Features for the perplexity strategies: pairs + perp of the seed-2021 predictions
    under a unigram LM fitted on the whole documents table."""
    lm = UnigramLM.fit(read_table(spark, sf_dir, "documents"), "text")
    p = preds(spark, sf_dir).filter(F.col("seed") == PERP_SEED)
    pp = perplexity(p, lm, "pred", ["row_id"])
    from selecta.sources.views import pairs
    return pairs(spark, sf_dir).join(pp, "row_id")


@query("ngram_perplexity", oracle=PERP_SQL + "SELECT row_id, perp FROM pp")
def q_ngram_perplexity(spark, sf_dir):
    """M3 (+ Q10)."""
    return perp_table(spark, sf_dir).select("row_id", "perp")


@query("perp_low", oracle=PERP_SQL + "SELECT row_id, instruction, input, output, perp FROM fe ORDER BY perp, row_id LIMIT 50")
def q_perp_low(spark, sf_dir):
    """X3 `perp` / T2."""
    return top_n(perp_table(spark, sf_dir), "perp", 50, ascending=True) \
        .select("row_id", "instruction", "input", "output", "perp")


@query("perp_high", oracle=PERP_SQL + "SELECT row_id, instruction, input, output, perp FROM fe ORDER BY perp DESC, row_id LIMIT 50")
def q_perp_high(spark, sf_dir):
    """X3 `perph` / T2."""
    return top_n(perp_table(spark, sf_dir), "perp", 50, ascending=False) \
        .select("row_id", "instruction", "input", "output", "perp")


@query("perp_mid", oracle=PERP_SQL + """
, rk AS (SELECT *, row_number() OVER (ORDER BY perp, row_id) - 1 AS r, count(*) OVER () AS n FROM fe)
SELECT row_id, instruction, input, output, perp FROM rk WHERE r >= greatest(n // 2 - 25, 0) AND r < least(greatest(n // 2 - 25, 0) + 50, n)""")
def q_perp_mid(spark, sf_dir):
    """X3 `perpm` / W3 (Q7): 50 rows around the median."""
    return middle_slice(perp_table(spark, sf_dir), "perp", 50) \
        .select("row_id", "instruction", "input", "output", "perp")
