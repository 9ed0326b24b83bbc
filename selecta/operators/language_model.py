"""M3: a word-order language model, interpolated Kneser-Ney over bigrams.

p(w | u) = (max(c(u w) - D, 0) + D * followers(u) * q(w)) / c(u), and
q(w) = (max(before(w) - D, 0) + D * V / (V + 1)) / B: ``before`` counts the
distinct words before w, ``followers`` the distinct words after u, B all
distinct bigrams and V the distinct words that follow anything; the slot
beside the V words is the unseen word. A text begins after the empty word. A
word u that nothing follows in the corpus backs off to q alone.

Plan: bigrams are counted within the tasks first, and written once, as all
tables of the model come from them. Texts are kept in blocks
(:mod:`selecta.operators.blocks`) and scored by their distinct bigrams, each
once for all texts and looked up once a block. A context is read by all
bigrams that begin with it: these are dealt to ``SALTS`` shares, and a share
asks for each of its contexts once, so that a very common word spreads over
that many tasks. No table is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selecta.functions.text import dummy_fill
from selecta.llm.common import stage
from selecta.operators.blocks import item_counts, packed, places, text_sums, word_pairs
from selecta.operators.features import FIXED_POINT
from selecta.operators.joins import one_row

SALTS = 16


def _words(pair: str) -> list[Column]:
    """u and w of a pair "u w"; words hold no space."""
    return [F.substring_index(pair, " ", 1).alias("u"), F.substring_index(pair, " ", -1).alias("w")]


def _asked(wanted: DataFrame, table: DataFrame, word: str, other: str) -> DataFrame:
    """``wanted`` with the columns of ``table`` for its ``word``, which each share by ``other`` asks for once."""
    shares = wanted.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    return shares.join(shares.select(word, "_salt").distinct().join(table, word), [word, "_salt"], "left").drop("_salt")


class BigramLM:
    """Kneser-Ney counts as tables that grow with the vocabulary, never collected:
    ``grams`` (u, w, c), ``contexts`` (u, cu, followers), ``words`` (w, before) and the one-row ``totals``."""

    def __init__(self, grams: DataFrame, discount: float = 0.75):
        if not 0 < discount < 1:
            raise ValueError("the discount lies between 0 and 1")
        self.grams, self.discount = grams, discount
        self.contexts = grams.groupBy("u").agg(F.sum("c").alias("cu"), F.count(F.lit(1)).alias("followers"))
        self.words = grams.groupBy("w").agg(F.count(F.lit(1)).alias("before"))
        self.totals = self.words.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("_b"), F.count(F.lit(1)).alias("_v"))

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text", discount: float = 0.75) -> "BigramLM":
        return cls(stage(item_counts(corpus, text, word_pairs).select(*_words("item"), "c"), "grams"), discount)

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """(u, w, logp) in fixed point for distinct bigrams (u, w)."""
        d = F.lit(self.discount)
        j = wanted.join(self.grams, ["u", "w"], "left")
        j = _asked(_asked(j, self.contexts, "u", "w"), self.words, "w", "u").crossJoin(one_row(self.totals))
        seen = F.greatest(F.coalesce(F.col("before"), F.lit(0)) - d, F.lit(0.0))
        q = F.when(F.col("_b") > 0, (seen + d * F.col("_v") / (F.col("_v") + 1)) / F.col("_b")).otherwise(F.lit(1.0))
        p = F.when(F.col("cu").isNull(), q).otherwise(
            (F.greatest(F.coalesce(F.col("c"), F.lit(0)) - d, F.lit(0.0)) + d * F.col("followers") * q) / F.col("cu"))
        return j.select("u", "w", F.round(F.log(p) * FIXED_POINT).cast("long").alias("logp"))


def ordered_perplexity(df: DataFrame, lm: BigramLM, text: str, keys: list[str], out: str = "perp") -> DataFrame:
    """(keys, out): exp(-mean log p) of each text; blank text scores as the blank prediction."""
    blocks = packed(df.withColumn(text, dummy_fill(F.col(text))), keys, text, word_pairs)
    asked = places(blocks, "item")
    scored = lm.log_probs(asked.select("item").distinct().select(*_words("item")))
    values = asked.join(scored.select(F.concat_ws(" ", "u", "w").alias("item"), F.col("logp").alias("value")), "item")
    agg = text_sums(blocks, values, keys)
    return agg.select(*keys, F.round(F.exp(-(F.col("_s") / FIXED_POINT) / F.col("_n")), 6).alias(out))
