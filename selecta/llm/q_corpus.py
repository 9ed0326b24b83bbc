"""Queries on single texts: decontamination, BPE, exact dedup, secrets, private data."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from selecta.llm import byte_bpe, decontaminate, exact_dedup, private_data, secrets
from selecta.llm.queries import query
from selecta.sources.tables import read_table


@query("op7_decontamination")
def op7(spark, sf_dir):
    """Benchmark windows of 10 words in every document."""
    hit = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hit.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(listed, 256).alias("items_sha256"), "contaminated")


RANKS = "byte_bpe_multi_50k.tiktoken"


def bpe_digests(docs, vocabulary, id_col="doc_id", text_col="text"):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded, then decoded texts."""
    return byte_bpe.digests(byte_bpe.encode(docs, vocabulary, id_col, text_col), vocabulary)


@query("op8_byte_bpe")
def op8(spark, sf_dir):
    """Every document encoded, decoded again, and digested."""
    vocabulary = byte_bpe.Vocabulary(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return bpe_digests(read_table(spark, sf_dir, "documents"), vocabulary)


SPACED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query("op9_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256({SPACED}) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def op9(spark, sf_dir):
    """Groups of equal texts, by recipes of content-defined chunks."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def _joined(spans):
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base():
    return F.filter("spans", lambda s: s["base"])


def _count(kind):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


@query("op2_private_data")
def op2(spark, sf_dir):
    """Personal data in every document: patterns, and a BiLSTM-CRF trained from them."""
    found = private_data.find_private(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count(k) for k in private_data.KINDS],
                        F.sha2(_joined(_base()), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query("op4_secrets")
def op4(spark, sf_dir):
    """Secrets in every document, with how many documents and sources hold them."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda verdict: F.size(F.filter("spans", lambda s: s["verdict"] == verdict)).cast("long").alias(f"n_{verdict}")
    return found.select("doc_id", *[_count(k) for k in ("assign", "access", "hex")],
                        F.sha2(_joined(_base()), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                        of("live"), of("copied"))
