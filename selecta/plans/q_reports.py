"""Queries: comparison and inspection reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.operators.features import length_features, open_ended_scores
from selecta.operators.rank import sample_random_n
from selecta.operators.reports import (
    axis_bounds, compare_runs, match_selection, membership_flags, not_selected, region_inspect,
)
from selecta.operators.selector import local_select
from selecta.operators.strategies import top_n
from selecta.plans.q_features import LENGTH_SQL, OE_SQL
from selecta.plans.q_prompts import K, MEMBERS_SQL, members
from selecta.plans.registry import query
from selecta.plans.sqlbits import INSTR, PREDS, md5key, with_
from selecta.sources.views import instr, multi, preds

SEED = 2023
RUNS = [2021, 2022, 2023]


@query("compare_pivot", oracle=with_(PREDS) + """
SELECT row_id, gt, max(CASE WHEN seed = 2021 THEN pred END) AS run_2021,
       max(CASE WHEN seed = 2022 THEN pred END) AS run_2022, max(CASE WHEN seed = 2023 THEN pred END) AS run_2023
FROM preds GROUP BY row_id, gt ORDER BY row_id LIMIT 50""")
def q_compare_pivot(spark, sf_dir):
    """A20 + T10: truth and one column per run, first 50 rows (the page size)."""
    p = preds(spark, sf_dir).withColumnRenamed("seed", "run")
    return compare_runs(p, RUNS, extra=["gt"], first_n=50)


SEL_SQL = LENGTH_SQL + f"""
, sa AS (SELECT row_id FROM instr ORDER BY {md5key(SEED)}, row_id LIMIT 100),
sb AS (SELECT row_id FROM h ORDER BY normalized_lengths DESC, row_id LIMIT 100)
"""


def _selections(spark, sf_dir):
    rows = instr(spark, sf_dir)
    a = sample_random_n(rows, 100, SEED).select("row_id")
    b = top_n(length_features(rows), "normalized_lengths", 100, ascending=False).select("row_id")
    return rows, a, b


@query("membership_flags", oracle=SEL_SQL + """
SELECT i.row_id, sa.row_id IS NOT NULL AS in_random, sb.row_id IS NOT NULL AS in_length,
       sa.row_id IS NULL AND sb.row_id IS NULL AS in_none
FROM instr i LEFT JOIN sa USING (row_id) LEFT JOIN sb USING (row_id)""")
def q_membership_flags(spark, sf_dir):
    """F8: which selections each row is in."""
    rows, a, b = _selections(spark, sf_dir)
    return membership_flags(rows.select("row_id"), {"random": a, "length": b}) \
        .select("row_id", "in_random", "in_length", "in_none")


@query("not_selected", oracle=SEL_SQL + """
SELECT row_id FROM instr WHERE row_id NOT IN (SELECT row_id FROM sa) AND row_id NOT IN (SELECT row_id FROM sb)""")
def q_not_selected(spark, sf_dir):
    """The complement of A union B."""
    rows, a, b = _selections(spark, sf_dir)
    return not_selected(rows.select("row_id"), [a, b])


@query("match_selection", oracle=with_(INSTR) + f"""
, s AS (SELECT instruction, output FROM instr ORDER BY {md5key(SEED)}, row_id LIMIT 100)
SELECT i.row_id, i.instruction, i.output FROM s JOIN instr i ON i.instruction = s.instruction AND i.output = s.output""")
def q_match_selection(spark, sf_dir):
    """J2 (Q23): a selection without ids matched back on (instruction, output)."""
    rows = instr(spark, sf_dir)
    sel = sample_random_n(rows, 100, SEED).select("instruction", "output")
    return match_selection(sel, rows, ["instruction", "output"]).select("row_id", "instruction", "output")


@query("region_inspect", oracle=MEMBERS_SQL + f"""
SELECT row_id, region_id, pos, pick < {K} AS chosen FROM t""")
def q_region_inspect(spark, sf_dir):
    """J11 + W4: every region's members, flagged where the selector chose them."""
    mem = members(spark, sf_dir)
    chosen = local_select(mem, K)
    return region_inspect(mem, chosen).select("row_id", "region_id", "pos", "chosen")


PLOT_SQL = LENGTH_SQL.replace("WITH ", "WITH " + OE_SQL[len("WITH "):].rstrip().rstrip(",") + ",\n", 1) + f"""
, sa AS (SELECT row_id FROM instr ORDER BY {md5key(SEED)}, row_id LIMIT 100),
pt AS (SELECT h.row_id, round(h.lengths, 6) AS lengths, round(h.normalized_lengths, 6) AS normalized_lengths,
              oe.n_unique_bigrams, sa.row_id IS NOT NULL AS in_random
       FROM h LEFT JOIN oe USING (row_id) LEFT JOIN sa USING (row_id))
"""


def plot_table(spark, sf_dir):
    rows = instr(spark, sf_dir)
    f = length_features(rows).select("row_id", F.round("lengths", 6).alias("lengths"),
                                     F.round("normalized_lengths", 6).alias("normalized_lengths"))
    oe = open_ended_scores(multi(spark, sf_dir)).select("row_id", "n_unique_bigrams")
    flags = membership_flags(f.join(oe, "row_id", "left"),
                             {"random": sample_random_n(rows, 100, SEED)})
    return flags.select("row_id", "lengths", "normalized_lengths", "n_unique_bigrams", "in_random")


@query("plot_table", oracle=PLOT_SQL + "SELECT * FROM pt")
def q_plot_table(spark, sf_dir):
    """Per-row coordinates, scores and selection flags in one wide table."""
    return plot_table(spark, sf_dir)


@query("axis_bounds", oracle=PLOT_SQL + """
SELECT min(normalized_lengths) - 1 AS x_min, max(normalized_lengths) + 1 AS x_max,
       min(n_unique_bigrams) - 1 AS y_min, max(n_unique_bigrams) + 1 AS y_max FROM pt""")
def q_axis_bounds(spark, sf_dir):
    """Plot bounds (min - 1, max + 1)."""
    return axis_bounds(plot_table(spark, sf_dir), "normalized_lengths", "n_unique_bigrams")
