"""Selection strategies: pick exactly n rows (the public ``select`` API).

Every top-n is ``orderBy(...).limit(n)`` kept adjacent, which plans as
TakeOrderedAndProject: each partition keeps n candidates, one task merges
P*n rows — bounded by the request, not by the table. Sort keys end in
``row_id`` (Q9) and NaN scores sort last in both directions (Q8).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selecta.operators.rank import global_rank, sample_random_n


def _nan_last(score: Column) -> Column:
    return F.nullif(score, F.lit(float("nan")))


def top_n(df: DataFrame, score: str, n: int, ascending: bool = True, id_col: str = "row_id") -> DataFrame:
    """N rows with the smallest (largest) score; NaN / NULL last."""
    s = _nan_last(F.col(score))
    key = s.asc_nulls_last() if ascending else s.desc_nulls_last()
    return df.orderBy(key, F.col(id_col).asc()).limit(n)


def middle_slice(df: DataFrame, score: str, n: int, parity: bool = False, id_col: str = "row_id",
                 n_rows: int | None = None) -> DataFrame:
    """W3 (Q7): n rows around the median of ``score``.

    Default: ranks [mid - n//2, mid - n//2 + n) clamped to the table. With
    ``parity=True`` the reference's literal slice [mid - n//2, mid + n//2),
    which yields n-1 rows for odd n.
    """
    ranked = global_rank(df.withColumn("_s", _nan_last(F.col(score))),
                         [F.col("_s").asc_nulls_last(), F.col(id_col)], "_rk")
    total = n_rows if n_rows is not None else ranked.count()      # of the copy that the rank has made
    mid, half = total // 2, n // 2
    start = max(mid - half, 0)
    end = (mid + half) if parity else (start + n)
    end = min(end, total)
    return ranked.filter((F.col("_rk") >= start) & (F.col("_rk") < end)).drop("_s", "_rk")


def first_n_by_id(df: DataFrame, n: int, id_col: str = "row_id") -> DataFrame:
    """Q6: the first n rows in row order (after a filter)."""
    return df.orderBy(id_col).limit(n)


def combined_filter(features: DataFrame, n: int, perp_min: float = 0.3, rouge_min: float = 0.005,
                    rouge_max: float = 0.7) -> DataFrame:
    """Strict range conjunction, then the first n by row_id."""
    kept = features.filter((F.col("perp") > perp_min) & (F.col("rouge") > rouge_min) &
                           (F.col("rouge") < rouge_max))
    return first_n_by_id(kept, n)


STRATEGIES = ("random", "length_small", "length_big", "perp", "perph", "perpm", "rouge",
              "combined", "oe", "diversity", "coreset", "instructor", "regions")


def select(df: DataFrame, strategy: str, n: int, seed: int = 2023, **params) -> DataFrame:
    """Pick exactly n rows of ``df`` (row_id + features as each strategy needs).

    Feature strategies expect the feature column on ``df`` (``lengths`` /
    ``normalized_lengths``, ``perp``, ``rouge``, ``n_unique_bigrams``,
    ``rouge_max``); vector strategies expect ``embedding``.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {STRATEGIES}")
    if strategy == "random":
        return sample_random_n(df, n, seed)
    if strategy == "length_small":
        return top_n(df, "normalized_lengths", n, ascending=True)
    if strategy == "length_big":
        return top_n(df, "normalized_lengths", n, ascending=False)
    if strategy == "perp":
        return top_n(df, "perp", n, ascending=True)
    if strategy == "perph":
        return top_n(df, "perp", n, ascending=False)
    if strategy == "perpm":
        return middle_slice(df, "perp", n, parity=params.get("parity", False))
    if strategy == "rouge":
        return top_n(df, "rouge", n, ascending=False)
    if strategy == "combined":
        return combined_filter(df, n)
    if strategy == "oe":
        return top_n(df, "n_unique_bigrams", n, ascending=False)
    if strategy == "diversity":
        return top_n(df, "rouge_max", n, ascending=True)
    if strategy in ("coreset", "instructor"):
        from selecta.operators.coreset import coreset_select
        return coreset_select(df, n, seed=seed, **params)
    if strategy == "regions":
        return region_select(df, n, seed, **params)
    raise AssertionError(strategy)


PARTITIONS = ("random", "balanced", "similar", "farthest")


def region_select(df: DataFrame, n: int, seed: int = 2023, n_regions: int = 1000, partition: str | None = None,
                  layout: str = "deal", selector=None) -> DataFrame:
    """``n_regions`` regions of ceil(N / n_regions) rows, n // n_regions rows picked in each; exactly n rows or an error.

    ``partition``: ``random`` (X11), ``balanced`` (X12, k-means clusters; the
    default when ``df`` has vectors), ``similar`` (X14) or ``farthest`` (X13).
    """
    from selecta.operators.kcenter import kcenter
    from selecta.operators.regions import diverse_regions, farthest_regions, random_regions, similar_regions
    from selecta.operators.selector import local_select
    from selecta.operators.vectors import kmeans_centers
    partition = partition or ("balanced" if "embedding" in df.columns else "random")
    if partition not in PARTITIONS:
        raise ValueError(f"unknown partition {partition!r}; choose one of {PARTITIONS}")
    if n % n_regions:
        raise ValueError(f"n={n} is not a multiple of n_regions={n_regions}")
    k = n // n_regions
    if partition == "random":
        members = random_regions(df, n_regions, seed, layout=layout)
    else:
        total = df.count()
        size = math.ceil(total / n_regions)
        points = df.select("row_id", "embedding")
        if partition == "balanced":
            placed = diverse_regions(points, kmeans_centers(points, size), n_regions, pad=False, seed=seed, n_rows=total)
        elif partition == "similar":
            picks = kcenter(points, n_regions, seed=seed, mode="two_level")
            seeds = picks.join(points, "row_id").select(F.col("pick").alias("cid"), F.col("embedding").alias("center"))
            placed = similar_regions(points, seeds, size, pad=False, seed=seed, n_rows=total)
        else:
            placed = farthest_regions(points, size, pad=False, seed=seed, n_rows=total)
        members = placed.join(df, "row_id")
    out = local_select(members, k, selector=selector)
    got = out.count()                          # on the n-row result
    if got != n:
        raise ValueError(f"region selection returned {got} rows, expected {n}")
    return out
