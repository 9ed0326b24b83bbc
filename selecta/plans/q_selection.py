"""Queries: the flagship region selection and the seeded-order operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from selecta.operators.rank import sample_random_n, seeded_rank, split_train_validation
from selecta.operators.regions import random_regions
from selecta.operators.selector import local_select
from selecta.plans.registry import query
from selecta.plans.sqlbits import INSTR, md5key, tok, with_
from selecta.sources.views import instr

SEED = 2023
FLAGSHIP_REGION_SIZE = 20
FLAGSHIP_K = 2


def flagship(spark, sf_dir, seed: int = SEED, region_size: int = FLAGSHIP_REGION_SIZE, k: int = FLAGSHIP_K):
    """X16 with random regions: seeded deal into ceil(N/size) regions, the
    built-in selector answers k per region, answers parsed and mapped back."""
    rows = instr(spark, sf_dir)
    n_regions = math.ceil(rows.count() / region_size)
    members = random_regions(rows, n_regions, seed, layout="deal")
    chosen = local_select(members, k)
    return chosen.select("row_id", "region_id", "pos", "pick")


query("select_flagship", oracle=with_(INSTR, f"""
r AS (SELECT row_id, instruction, input,
             row_number() OVER (ORDER BY {md5key(SEED)}, row_id) - 1 AS rk FROM instr),
p AS (SELECT CAST(ceil(count(*) / {FLAGSHIP_REGION_SIZE}.0) AS BIGINT) AS nr FROM instr),
m AS (SELECT r.row_id, CAST(rk % nr AS INTEGER) AS region_id, CAST(rk // nr AS INTEGER) AS pos,
             len(list_distinct({tok("concat_ws(' ', instruction, input)")})) AS score FROM r, p),
t AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY score DESC, pos) - 1 AS pick FROM m)
""") + f"SELECT row_id, region_id, pos, CAST(pick AS INTEGER) AS pick FROM t WHERE pick < {FLAGSHIP_K}")(flagship)


@query("sample_random_n", oracle=with_(INSTR) + f"""
SELECT row_id, instruction, input, output, source FROM instr
ORDER BY {md5key(SEED)}, row_id LIMIT 100""")
def q_sample_random_n(spark, sf_dir):
    """Exactly 100 rows, seeded."""
    return sample_random_n(instr(spark, sf_dir), 100, SEED)


@query("random_regions", oracle=with_(INSTR) + f"""
, p AS (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS sz, count(*) AS n FROM instr),
r AS (SELECT row_id, row_number() OVER (ORDER BY {md5key(SEED)}, row_id) - 1 AS rk FROM instr),
padded AS (SELECT row_id, rk FROM r UNION ALL
           SELECT row_id, rk + n FROM r, p WHERE rk < sz * 7 - n)
SELECT row_id, CAST(rk // sz AS INTEGER) AS region_id, CAST(rk % sz AS INTEGER) AS pos FROM padded, p""")
def q_random_regions(spark, sf_dir):
    """W1 + U3: 7 regions of ceil(N/7) rows, block layout, padded by re-use."""
    return random_regions(instr(spark, sf_dir).select("row_id"), 7, SEED, layout="block", pad=True) \
        .select("row_id", "region_id", "pos")


@query("split_80_20", oracle=with_(INSTR) + f"""
, r AS (SELECT row_id, row_number() OVER (ORDER BY {md5key(2021)}, row_id) - 1 AS rk,
              count(*) OVER () AS n FROM instr)
SELECT row_id, CASE WHEN rk < floor(n * 0.8) THEN 'train' ELSE 'validation' END AS split FROM r""")
def q_split(spark, sf_dir):
    """Exact seeded 80/20 split."""
    return split_train_validation(instr(spark, sf_dir).select("row_id"), 2021).select("row_id", "split")


@query("seeded_rank", oracle=with_(INSTR) + f"""
SELECT row_id, row_number() OVER (ORDER BY {md5key(SEED)}, row_id) - 1 AS rank FROM instr""")
def q_seeded_rank(spark, sf_dir):
    """The global rank every seeded operator builds on (no single-partition window)."""
    return seeded_rank(instr(spark, sf_dir).select("row_id"), SEED).select("row_id", "rank")
