"""Evaluation: score predictions against ground truth per run and seed.

J1 (pairs by key, not by position: Q24), E2/E3 ROUGE, J6/E5 diagonal
cosine, A13-A17 means.

Text vectors for the cosine are exact bag-of-words counts. A pair's cosine
needs its own two texts only, so it is a column computed row by row in Arrow
batches: no token leaves its row, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.functions.text import tokens


@F.pandas_udf(T.DoubleType())
def _counts_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        cx, cy = Counter(x), Counter(y)
        dot = sum(n * cy[t] for t, n in cx.items())
        na, nb = sum(n * n for n in cx.values()), sum(n * n for n in cy.values())
        out.append(dot / math.sqrt(na * nb) if na and nb else 0.0)
    return pd.Series(out)


def bow_cosine(a: str, b: str) -> Column:
    """Cosine of the token-count vectors of columns a and b; 0 when either text has no tokens."""
    return _counts_cosine(tokens(F.coalesce(F.col(a), F.lit(""))), tokens(F.coalesce(F.col(b), F.lit(""))))


def matched_pairs(predictions: DataFrame, truths: DataFrame, key: str = "row_id") -> DataFrame:
    """J1 (Q24): predictions and truths aligned by key, full outer, with ``match``:
    both, prediction or truth (the last two are the unmatched rows)."""
    p, t = predictions.withColumn("_p", F.lit(True)), truths.withColumn("_t", F.lit(True))
    side = F.when(F.col("_p").isNull(), "truth").when(F.col("_t").isNull(), "prediction").otherwise("both")
    return p.join(t, key, "full").withColumn("match", side).drop("_p", "_t")


def seed_average(per_seed: DataFrame, group_keys: list[str], metrics: list[str]) -> DataFrame:
    """Equal-weight average of the per-seed means (two-level aggregate)."""
    return per_seed.groupBy(*group_keys).agg(*[F.avg(m).alias(m) for m in metrics]) if group_keys \
        else per_seed.agg(*[F.avg(m).alias(m) for m in metrics])
