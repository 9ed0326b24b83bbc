"""Corpus preparation: harmonise sources to one schema, union, deduplicate.

P1-P6, U1, A1-A4, F4. Each source is (DataFrame, name, rename map); the
result has the canonical four string columns. Dedup is a hash aggregate
with map-side partial aggregation, so a text repeated a billion times
collapses before the shuffle (no skew problem).
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = ("instruction", "input", "output", "source")
TEXT_COLUMNS = ("instruction", "input", "output")


def _as_text(c: Column, dtype: T.DataType) -> Column:
    """Cast to string; arrays / maps / structs become their JSON form."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def harmonize(df: DataFrame, source: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """P1 rename, P2 add source, P3 add missing as '', P4 project, P5 fill, P6 cast."""
    if rename:
        df = df.withColumnsRenamed(dict(rename))
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in TEXT_COLUMNS:
        if c in types:
            cols.append(F.coalesce(_as_text(F.col(c), types[c]), F.lit("")).alias(c))
        else:
            cols.append(F.lit("").alias(c))
    cols.append(F.lit(source).alias("source"))
    return df.select(*cols)


def union_sources(parts: Iterable[DataFrame]) -> DataFrame:
    """Union all by name."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedup(df: DataFrame, per_source: bool = True) -> DataFrame:
    """A1: exact duplicate rows removed (per source first, then globally)."""
    return df.dropDuplicates(list(CANONICAL)) if per_source else df.distinct()


def dedup_shape(df: DataFrame) -> DataFrame:
    """A4: one row (rows_before, rows_after, distinct_sentences) from one pass over ``df``.

    The rows are counted per distinct row, as dedup groups them, then per distinct text; partial counts
    combine before each shuffle. Counts that are observed on the side (accumulators) would
    count the rows of a map task again that is run again after its executor is lost; these do not.
    """
    rows = df.groupBy(*CANONICAL).agg(F.count(F.lit(1)).alias("n"))
    per_text = rows.groupBy(sentence_key(rows).alias("sentences")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kept"))
    return per_text.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_before"),
                        F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("rows_after"),
                        F.count("sentences").alias("distinct_sentences"))


def sentence_key(df: DataFrame, safe: bool = False) -> Column:
    """instruction+input+output without separator (reference key), or a
    collision-safe struct key."""
    if safe:
        return F.struct(*[F.col(c) for c in TEXT_COLUMNS])
    return F.concat(*[F.col(c) for c in TEXT_COLUMNS])


def duplicate_sources(df: DataFrame) -> DataFrame:
    """A3: for every distinct text, the sources holding it with their counts.

    Pre-aggregated per (text, source) first: a text present in a third of all
    rows becomes one row per source before any grouping by text, and the
    per-text list holds at most one entry per source.
    """
    key = sentence_key(df).alias("sentences")
    per_source = df.groupBy(key, "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("sentences").agg(
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"),
        F.sum("n").cast("long").alias("n_rows"),
    )


def source_counts(df: DataFrame, stage: str) -> DataFrame:
    """A2: per-source row count and non-null / non-empty counts per column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in TEXT_COLUMNS:
        aggs.append(F.count(F.col(c)).alias(f"n_{c}"))
        aggs.append(F.count(F.when(F.col(c) != "", True)).alias(f"nonempty_{c}"))
    return df.groupBy("source").agg(*aggs).withColumn("stage", F.lit(stage))


def filter_sources(df: DataFrame, include: Iterable[str] | None = None,
                   exclude: Iterable[str] | None = None) -> DataFrame:
    """keep listed sources / drop listed sources."""
    if include is not None:
        df = df.filter(F.col("source").isin(list(include)))
    if exclude is not None:
        df = df.filter(~F.col("source").isin(list(exclude)))
    return df
