"""Queries: corpus harmonisation, union, dedup, per-source counts (E4 flow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.operators.harmonize import (
    dedup, dedup_shape, duplicate_sources, filter_sources, harmonize, source_counts, union_sources,
)
from selecta.plans.registry import query
from selecta.plans.sqlbits import PAIRS, with_
from selecta.sources import views

# The source registry of the test corpus (name -> rename map).
REGISTRY = {
    "documents": (views.src_documents, {"instruction_text": "instruction"}),
    "benchmark": (views.src_benchmark, {"question": "instruction"}),
    "pairs": (views.src_pairs, {"prompt": "instruction", "context": "input", "response": "output"}),
}


def corpus(spark, sf_dir):
    return union_sources(harmonize(reader(spark, sf_dir), name, ren)
                         for name, (reader, ren) in REGISTRY.items())


CORPUS = PAIRS + """,
corpus AS (
  SELECT coalesce(text, '') AS instruction, '' AS input, '' AS output, 'documents' AS source FROM documents
  UNION ALL SELECT coalesce(text, ''), '', '', 'benchmark' FROM benchmark
  UNION ALL SELECT coalesce(instruction, ''), coalesce(input, ''), coalesce(output, ''), 'pairs' FROM pairs)"""


@query("harmonize_union", oracle=with_(CORPUS) + "SELECT * FROM corpus")
def q_harmonize_union(spark, sf_dir):
    """P1-P6 + U1."""
    return corpus(spark, sf_dir)


@query("dedup_rows", oracle=with_(CORPUS) + "SELECT DISTINCT * FROM corpus")
def q_dedup_rows(spark, sf_dir):
    """A1: per-source then global exact dedup."""
    return dedup(dedup(corpus(spark, sf_dir)), per_source=False)


_COUNTS = """
SELECT source, '{stage}' AS stage, count(*) AS n_rows,
  count(instruction) AS n_instruction, count(CASE WHEN instruction <> '' THEN 1 END) AS nonempty_instruction,
  count(input) AS n_input, count(CASE WHEN input <> '' THEN 1 END) AS nonempty_input,
  count(output) AS n_output, count(CASE WHEN output <> '' THEN 1 END) AS nonempty_output
FROM {src} GROUP BY source"""


@query("source_counts", oracle=with_(CORPUS, "d AS (SELECT DISTINCT * FROM corpus)")
       + _COUNTS.format(stage="before", src="corpus") + " UNION ALL " + _COUNTS.format(stage="after", src="d"))
def q_source_counts(spark, sf_dir):
    """A2: per-source counts before and after dedup."""
    c = corpus(spark, sf_dir)
    return source_counts(c, "before").unionByName(source_counts(dedup(c), "after"))


@query("dup_sources", oracle=with_(CORPUS) + """
, ps AS (SELECT instruction || input || output AS sentences, source, count(*) AS n FROM corpus GROUP BY 1, 2)
SELECT md5(sentences) AS sentence_md5, list_sort(list(source || ':' || CAST(n AS VARCHAR))) AS sources,
       CAST(sum(n) AS BIGINT) AS n_rows
FROM ps GROUP BY sentences""")
def q_dup_sources(spark, sf_dir):
    """A3 + P11: texts with the sources that hold them."""
    g = duplicate_sources(corpus(spark, sf_dir))
    return g.select(F.md5("sentences").alias("sentence_md5"),
                    F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["n"].cast("string")))
                    .alias("sources"), "n_rows")


@query("dedup_before_after", oracle=with_(CORPUS) + """
SELECT (SELECT count(*) FROM corpus) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM corpus)) AS rows_after,
       (SELECT count(DISTINCT instruction || input || output) FROM corpus) AS distinct_sentences""")
def q_dedup_before_after(spark, sf_dir):
    """A4: shape before / after as one row, from one pass over the corpus."""
    return dedup_shape(corpus(spark, sf_dir))


@query("include_sources", oracle=with_(CORPUS) + """
SELECT * FROM corpus WHERE source IN ('documents', 'pairs') AND source NOT IN ('benchmark')""")
def q_include_sources(spark, sf_dir):
    """inclusion and exclusion lists."""
    return filter_sources(corpus(spark, sf_dir), include=["documents", "pairs"], exclude=["benchmark"])
