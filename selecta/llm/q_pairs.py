"""Queries that compare documents with one another: similarity join, substring dedup, MinHash groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.llm import minhash, similarity_join, substring_dedup
from selecta.llm.queries import query
from selecta.sources.tables import read_table


def classes_sql(k: int, num: int, more: str = "") -> str:
    """All pairs that share a shingle, compared whole; components by reachability."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^ 	-]+') AS words FROM documents),
     i AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0),
     s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + {k - 1}], ' ') AS shingle FROM i),
     n AS (SELECT w.doc_id, count(s.shingle) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {num} * (x.n + y.n - common)),
     u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id{more} FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""


@query("op5_similarity_join", classes_sql(4, 85))
def op5(spark, sf_dir):
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return similarity_join.similarity_classes(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    """Every document without the 50-word windows that a document of smaller id holds."""
    left = substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_minhash", classes_sql(5, 85, ", n.doc_id = min(r.b) AS kept"))
def op12(spark, sf_dir):
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.85 or more, by SuperMinHash."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), num=85)
