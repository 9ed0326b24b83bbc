"""Derived views that give the driver tables the shapes the operators take.

``instr``  (row_id, instruction, input, output, source)   from documents
``pairs``  (row_id, instruction, input, output)            from conversations
``preds``  (row_id, seed, gt, pred)                        from pairs
``multi``  (row_id, prompt, responses)                     from documents
``points`` (row_id, embedding, label)                      from embeddings
``src_*``  raw sources with their own column names         for harmonisation

Each is a plain projection / join, so Catalyst prunes and pushes through it.
"""

from __future__ import annotations

from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selecta.operators.blocks import words
from selecta.sources.tables import read_table

# The three evaluation runs as (seed, drop, replace): of every
# 256 tokens of the truth, a run's predictions lose ``drop`` and have
# ``replace`` others replaced.
PRED_RUNS = [(2021, 20, 40), (2022, 30, 20), (2023, 10, 10)]
REPLACED = "xx"


def instr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lines = F.split(F.col("text"), "\n")
    return (
        docs.select("doc_id", "source", lines.alias("l"))
        .select(
            F.col("doc_id").alias("row_id"),
            F.coalesce(F.get(F.col("l"), 0), F.lit("")).alias("instruction"),
            F.nullif(F.get(F.col("l"), 1), F.lit("")).alias("input"),
            F.array_join(F.slice(F.col("l"), 3, F.size("l")), "\n").alias("output"),
            "source",
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    y = conv.filter(F.col("role") == "system").select(
        "conv_id", F.col("text").alias("input"))
    return (
        u.join(a, ["conv_id", "turn"])
        .join(y, "conv_id", "left")
        .select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
            "instruction", "input", "output",
        )
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each run: the whole truth with its tokens reversed in
    threes, some dropped and some replaced, by a seeded hash of their place."""
    runs = spark.createDataFrame(PRED_RUNS, "seed int, drop int, swap int")
    # The run table has len(PRED_RUNS) rows: a fixed, proven-small broadcast.
    p = pairs(spark, sf_dir).select("row_id", F.col("output").alias("gt")).crossJoin(F.broadcast(runs))
    pred = _predicted(F.col("row_id").cast("string"), "seed", "drop", "swap", "gt")
    return p.select("row_id", "seed", "gt", pred.alias("pred"))


@F.pandas_udf(T.StringType())
def _predicted(row: pd.Series, seed: pd.Series, drop: pd.Series, swap: pd.Series, gt: pd.Series) -> pd.Series:
    def pred(row, seed, drop, swap, gt):
        if gt is None:
            return None
        t, place, out = words(gt), f"{seed}:" if row is None else f"{seed}:{row}:", []
        for i in (i for first in range(0, len(t), 3) for i in range(min(first + 3, len(t)) - 1, first - 1, -1)):
            h = md5(f"{place}{i}".encode()).digest()[0]
            if h >= drop:
                out.append(REPLACED if h < drop + swap else t[i])
        return " ".join(out)
    return pd.Series([pred(*r) for r in zip(row, seed, drop, swap, gt)], dtype=object)


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a response; its first line is the prompt."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.coalesce(F.split(F.col("text"), "\n"), F.array().cast("array<string>"))
    return docs.select(F.col("doc_id").alias("row_id"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("prompt"),
                       lines.alias("responses"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), "embedding", "label")


def src_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("text").alias("instruction_text"), F.col("source").alias("origin"), "lang")


def src_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"))


def src_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(
        F.col("instruction").alias("prompt"), F.col("input").alias("context"),
        F.col("output").alias("response"))
