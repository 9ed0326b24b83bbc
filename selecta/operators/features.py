"""Per-row features: length (A10/A11), open-endedness (A12), n-gram
perplexity (M3), and the feature table join (J9).

Scores that drive a selection are made reproducible: sums of log
probabilities are taken in fixed point (exact, order-independent integer
sums), and the final score is rounded to 6 digits, so the same rows are
chosen on any partitioning and in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selecta.functions.text import bigrams, dummy_fill
from selecta.operators.blocks import item_counts, packed, places, text_sums
from selecta.operators.joins import one_row

FIXED_POINT = 1e9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length_features(df: DataFrame, instruction="instruction", input_="input") -> DataFrame:
    """A10: lengths = len(input + instruction) / max; A11: min-max of that.

    The max / min come from a one-row aggregate joined back by a broadcast
    cross join (not a window over everything). Constant lengths give 0.0.
    """
    raw = F.length(F.concat(F.coalesce(_c(input_), F.lit("")),
                            F.coalesce(_c(instruction), F.lit("")))).cast("double")
    with_raw = df.withColumn("_raw", raw)
    stats = with_raw.agg(F.max("_raw").alias("_mx"), F.min("_raw").alias("_mn"))
    j = with_raw.crossJoin(one_row(stats))
    lengths = F.when(F.col("_mx") > 0, F.col("_raw") / F.col("_mx")).otherwise(F.lit(0.0))
    lo = F.when(F.col("_mx") > 0, F.col("_mn") / F.col("_mx")).otherwise(F.lit(0.0))
    hi = F.when(F.col("_mx") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    norm = F.when(hi > lo, (lengths - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return j.withColumn("lengths", lengths).withColumn("normalized_lengths", norm) \
        .drop("_raw", "_mx", "_mn")


def open_ended_scores(df: DataFrame, responses: str = "responses") -> DataFrame:
    """A12 + F2: distinct bigrams over all responses of a prompt; prompts with
    an empty response are dropped."""
    r = F.col(responses)
    ok = F.forall(r, lambda x: F.length(x) > 0)
    n = F.size(F.array_distinct(F.flatten(F.transform(r, lambda x: bigrams(x))))).cast("long")
    return df.filter(ok).withColumn("n_unique_bigrams", n)


class UnigramLM:
    """Corpus unigram model with add-k smoothing: p(w) = (c(w) + k) / (T + k V),
    V = distinct tokens + 1 (one slot for unseen tokens).

    ``counts`` (token, c) is a distributed table (grows with the vocabulary);
    ``totals`` is its one-row aggregate (tt, vv). Fitting runs no job: the
    counts aggregate appears twice in a scoring plan and Spark reuses the one
    shuffle (ReuseExchange).
    """

    def __init__(self, counts: DataFrame, k: float = 1.0):
        self.counts, self.k = counts, k
        self.totals = counts.agg(F.sum("c").alias("_tt"), (F.count(F.lit(1)) + 1).alias("_vv"))

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text", k: float = 1.0) -> "UnigramLM":
        return cls(item_counts(corpus, text).withColumnRenamed("item", "token"), k)

    def log_prob(self, c: Column) -> Column:
        k = F.lit(self.k)
        return F.log((F.coalesce(c, F.lit(0)) + k) / (F.col("_tt") + k * F.col("_vv")))


def perplexity(df: DataFrame, lm: UnigramLM, text: str, keys: list[str], out: str = "perp") -> DataFrame:
    """M3: exp(-mean log p) per text (Q10: blank text scored as 'dummy string').

    Texts are kept in blocks (:mod:`selecta.operators.blocks`): a token's
    probability is looked up once a block, so a hot token costs one row a block.
    The vocabulary join is left to AQE: broadcast when the runtime size of the
    vocabulary is under the threshold, else a shuffle join on token whose
    skewed partitions AQE splits.
    """
    blocks = packed(df.withColumn(text, dummy_fill(_c(text))), keys, text)
    j = places(blocks, "token").join(lm.counts, "token", "left").crossJoin(one_row(lm.totals))
    agg = text_sums(blocks, j.select("block", "pos", F.round(lm.log_prob(F.col("c")) * FIXED_POINT).cast("long").alias("value")), keys)
    return agg.select(*keys, F.round(F.exp(-(F.col("_s") / FIXED_POINT) / F.col("_n")), 6).alias(out))


def attach(df: DataFrame, *features: DataFrame, on: str = "row_id") -> DataFrame:
    """Attach feature columns by equi-join on the row key."""
    for f in features:
        df = df.join(f, on, "left")
    return df
