"""Queries: region prompts (B1-B6), answer parsing (E9, E10), user selector
(X15 via mapInPandas), list ranking picks (X17), token usage (A18)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from selecta.functions.text import parse_id_list, parse_ranking
from selecta.operators.prompts import STYLES, region_prompts
from selecta.operators.regions import random_regions
from selecta.operators.selector import (
    default_score, list_rank_pick, local_select, longest_instruction_selector, prompts_answers,
    scorer_answers, token_usage,
)
from selecta.plans.registry import query
from selecta.plans.sqlbits import INSTR, md5key, strip, tok, with_
from selecta.sources.tables import read_table
from selecta.sources.views import instr

SEED = 2023
REGION_SIZE = 20
K = 2

MEMBERS_SQL = with_(INSTR, f"""
r AS (SELECT row_id, instruction, input, row_number() OVER (ORDER BY {md5key(SEED)}, row_id) - 1 AS rk FROM instr),
p AS (SELECT CAST(ceil(count(*) / {REGION_SIZE}.0) AS BIGINT) AS nr FROM instr),
m AS (SELECT r.row_id, r.instruction, r.input, CAST(rk % nr AS INTEGER) AS region_id, CAST(rk // nr AS INTEGER) AS pos,
             len(list_distinct({tok("concat_ws(' ', instruction, input)")})) AS score FROM r, p),
t AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY score DESC, pos) - 1 AS pick,
             count(*) OVER (PARTITION BY region_id) AS rs FROM m)
""")


def members(spark, sf_dir):
    rows = instr(spark, sf_dir)
    n_regions = math.ceil(rows.count() / REGION_SIZE)
    return random_regions(rows, n_regions, SEED, layout="deal")


def _sql_text(template: str, n: str, k: int, chosen: str | None = None) -> str:
    """A style template as a DuckDB string expression."""
    ex1 = "[" + ", ".join(str(i) for i in range(1, k + 1)) + "]"
    ex2 = "[" + ", ".join(str(i) for i in range(k + 1, 2 * k + 1)) + "]"
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts.append("'" + before.replace("'", "''") + "'")
        parts.append({"n": f"CAST({n} AS VARCHAR)", "k": f"'{k}'", "ex1": f"'{ex1}'", "ex2": f"'{ex2}'",
                      "chosen": f"CAST({chosen} AS VARCHAR)"}[name])
    parts.append("'" + rest.replace("'", "''") + "'")
    return " || ".join(parts)


def _member_sql(null_input: str | None) -> str:
    nl = "chr(10)"
    head = f"'[' || CAST(pos + 1 AS VARCHAR) || ']' || {nl} || {nl} || '### Instruction:' || {nl} || ' ' || coalesce(instruction, '') || {nl} || {nl}"
    if null_input is None:
        inp = f"CASE WHEN input IS NULL THEN '' ELSE '### Input:' || {nl} || ' ' || input || {nl} || {nl} END"
    else:
        inp = f"'### Input:' || {nl} || ' ' || coalesce(input, ' {null_input}') || {nl} || {nl}"
    return f"{head} || {inp}"


def _prompt_sql(style: str) -> str:
    spec = STYLES[style]
    chosen = "c.chosen" if style == "rationale" else None
    body = f"string_agg({_member_sql(spec['null_input'])}, '' ORDER BY pos)"
    return (f"SELECT region_id, '{style}' AS style, count(*) AS n, {body} AS body FROM t GROUP BY region_id",
            _sql_text(spec["header"], "g.n", K) + " || g.body || " + _sql_text(spec["request"], "g.n", K, chosen))


def _prompts_oracle() -> str:
    parts = []
    for style in STYLES:
        agg, text = _prompt_sql(style)
        join = " JOIN (SELECT region_id, pos + 1 AS chosen FROM t WHERE pick = 0) c USING (region_id)" \
            if style == "rationale" else ""
        parts.append(f"SELECT g.region_id, g.style, md5({text}) AS prompt_md5, CAST(length({text}) AS BIGINT) AS prompt_chars "
                     f"FROM ({agg}) g{join}")
    return MEMBERS_SQL + " UNION ALL ".join(parts)


@query("region_prompts", oracle=_prompts_oracle())
def q_region_prompts(spark, sf_dir):
    """Every prompt style for every region (the rationale style names
    the built-in selector's first pick)."""
    mem = members(spark, sf_dir)
    first = local_select(mem, 1).select("region_id", F.col("pos").alias("chosen_pos"))
    out = None
    for style in STYLES:
        pr = region_prompts(mem, K, style, chosen=first if style == "rationale" else None)
        pr = pr.select("region_id", F.lit(style).alias("style"), F.md5("prompt").alias("prompt_md5"),
                       F.length("prompt").cast("long").alias("prompt_chars"))
        out = pr if out is None else out.unionByName(pr)
    return out


def _answers_sql() -> str:
    return MEMBERS_SQL + f""",
sc AS (SELECT region_id, CAST(rs AS INTEGER) AS rs,
              '[' || string_agg(CAST(pos + 1 AS VARCHAR), ', ' ORDER BY pick) FILTER (WHERE pick < {K}) || ']' AS ans_ids,
              string_agg('[' || CAST(pos + 1 AS VARCHAR) || ']', ' > ' ORDER BY pick) AS ans_rank
       FROM t GROUP BY region_id, rs),
cv AS (SELECT conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'assistant'),
ans AS (SELECT 'scorer' AS src, CAST(region_id AS BIGINT) AS id, ans_ids AS answer, ans_rank AS ranking, rs FROM sc
        UNION ALL SELECT 'conversation', id, text, text, {REGION_SIZE} FROM cv)
"""


PARSE_IDS_SQL = _answers_sql() + f"""
, pa AS (SELECT src, id, rs, {strip("answer")} AS a FROM ans),
px AS (SELECT src, id, CASE WHEN regexp_matches(a, '^\\[\\s*[0-9]+(\\s*,\\s*[0-9]+)*\\s*\\]$') THEN
         list_filter(list_transform(regexp_extract_all(a, '([0-9]+)', 1), lambda x: CAST(x AS INTEGER) - 1),
                     lambda x: x >= 0 AND x < rs) END AS l FROM pa)
SELECT src, id, CASE WHEN l IS NULL THEN NULL ELSE list_filter(l, lambda x, i: list_position(l, x) = i) END AS ids FROM px"""


def _answers(spark, sf_dir):
    mem = members(spark, sf_dir)
    sc = scorer_answers(mem, K).select(F.lit("scorer").alias("src"), F.col("region_id").cast("long").alias("id"),
                                       "answer", F.col("region_size").alias("rs"))
    full = scorer_answers(mem, REGION_SIZE).select(
        F.col("region_id").cast("long").alias("id"),
        F.array_join(F.transform(F.split(F.regexp_replace("answer", r"^\[|\]$", ""), ", "),
                                 lambda x: F.concat(F.lit("["), x, F.lit("]"))), " > ").alias("ranking"))
    sc = sc.join(full, "id")
    cv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        F.lit("conversation").alias("src"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("text").alias("answer"), F.col("text").alias("ranking"), F.lit(REGION_SIZE).alias("rs"))
    return sc.select("src", "id", "answer", "ranking", "rs").unionByName(cv)


@query("parse_ids", oracle=PARSE_IDS_SQL)
def q_parse_ids(spark, sf_dir):
    """E9 (+Q15/Q16): selector answers -> 0-based ids, NULL when malformed."""
    a = _answers(spark, sf_dir)
    return a.select("src", "id", parse_id_list(F.col("answer"), F.col("rs")).alias("ids"))


@query("parse_ranking", oracle=_answers_sql() + """
, it AS (SELECT src, id, list_transform(string_split(coalesce(ranking, ''), '>'),
                                         lambda s: regexp_replace(s, '^[ \\[]+|[ \\]]+$', '', 'g')) AS items FROM ans)
SELECT src, id, CASE WHEN list_bool_and(list_transform(items, lambda s: regexp_matches(s, '^[0-9]+$')))
       THEN list_transform(items, lambda s: CAST(s AS INTEGER) - 1) END AS order_ids FROM it""")
def q_parse_ranking(spark, sf_dir):
    """E10: '[2] > [5] > [1]' -> [1, 4, 0], NULL when malformed."""
    a = _answers(spark, sf_dir)
    return a.select("src", "id", parse_ranking(F.col("ranking")).alias("order_ids"))


@query("local_select", oracle=MEMBERS_SQL + f"""
, lt AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY length(instruction) DESC, pos) - 1 AS lp FROM t)
SELECT row_id, region_id, pos, CAST(lp AS INTEGER) AS pick FROM lt WHERE lp < {K}""")
def q_local_select(spark, sf_dir):
    """X15 with a user selector run by mapInPandas on the region prompts."""
    mem = members(spark, sf_dir)
    out = local_select(mem, K, selector=longest_instruction_selector, style="local")
    return out.select("row_id", "region_id", "pos", "pick")


@query("token_usage", oracle=MEMBERS_SQL + f"""
, g AS (SELECT region_id, count(*) AS n, string_agg({_member_sql(None)}, '' ORDER BY pos) AS body FROM t GROUP BY region_id),
pp AS (SELECT {_sql_text(STYLES['local']['header'], 'n', K)} || body || {_sql_text(STYLES['local']['request'], 'n', K)} AS prompt FROM g)
SELECT CAST(sum(len({tok("prompt")})) AS BIGINT) AS in_tokens, CAST(count(*) * {K} AS BIGINT) AS out_tokens,
       count(*) AS n_calls FROM pp""")
def q_token_usage(spark, sf_dir):
    """Selector token totals over all regions."""
    mem = members(spark, sf_dir)
    answers = prompts_answers(mem, K, longest_instruction_selector, style="local")
    return token_usage(answers)


@query("list_rank_pick", oracle=MEMBERS_SQL + """
SELECT row_id, region_id, pos FROM t WHERE pick = CAST(floor(rs / 2) AS BIGINT)""")
def q_list_rank_pick(spark, sf_dir):
    """Full ranking per region (built-in scorer), keep the center element."""
    mem = members(spark, sf_dir)
    full = scorer_answers(mem, REGION_SIZE)
    ranking = full.select("region_id", "region_size", F.array_join(
        F.transform(F.split(F.regexp_replace("answer", r"^\[|\]$", ""), ", "),
                    lambda x: F.concat(F.lit("["), x, F.lit("]"))), " > ").alias("answer"))
    return list_rank_pick(mem, ranking, "center").select("row_id", "region_id", "pos")
