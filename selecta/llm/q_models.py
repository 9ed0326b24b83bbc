"""Queries of the trained text classifiers: toxicity, language, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.llm import language, quality, toxicity
from selecta.llm.queries import query
from selecta.sources.tables import read_table


@query("op1_toxicity")
def op1(spark, sf_dir):
    """Toxicity chain, trained on labelled rows, over every document."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@query("op3_language")
def op3(spark, sf_dir):
    """Language of every document; one quarter of the documents is held out of training."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def op10(spark, sf_dir):
    """Expected grade and selection of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), quality.label_grade(), quality.GRADES)
    return quality.score(docs, model)
