"""The corpus pipeline: five stages, each working on all that its predecessor kept.

quality classifier -> exact dedup -> near-duplicate join -> benchmark
decontamination -> byte-level BPE. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from selecta.llm import byte_bpe, decontaminate, exact_dedup, quality, similarity_join
from selecta.llm.common import stage
from selecta.llm.q_corpus import RANKS, bpe_digests
from selecta.llm.queries import query
from selecta.session import ship_package
from selecta.sources.tables import read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is probably not the lowest (op 10)."""
    ship_package(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), quality.label_grade(), quality.GRADES)
    return quality.keep_good(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (op 9)."""
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, 0.8 (op 5)."""
    ship_package(spark)
    return similarity_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark (op 7)."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left (op 8)."""
    ship_package(spark)
    return bpe_digests(docs, byte_bpe.Vocabulary(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_enough),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: Trained weights, sketches and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
