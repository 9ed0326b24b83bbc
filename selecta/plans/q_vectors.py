"""Queries: vector operators on the embeddings table and on encoded documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from selecta.functions.vectors import l2_normalize
from selecta.operators.encode import pooled_vector
from selecta.operators.vectors import centroids, coverage_radius, farthest_point, min_distance
from selecta.plans.registry import query
from selecta.plans.sqlbits import POINTS, strip, tok, with_
from selecta.sources.tables import read_table
from selecta.sources.views import points

CENTER_DIGITS = 9


def _r6(col):
    return F.transform(col, lambda x: F.round(x, 6))


def NRM(v: str) -> str:
    return f"sqrt(list_reduce(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b))"


@query("l2_norm", oracle=with_(POINTS) + f"""
SELECT row_id, CASE WHEN {NRM("embedding")} > 0 THEN
  list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / {NRM("embedding")}, 6)) END AS vec FROM points""")
def q_l2_norm(spark, sf_dir):
    """Unit vectors (zero vector -> NULL)."""
    return points(spark, sf_dir).select("row_id", _r6(l2_normalize("embedding")).alias("vec"))


CENT_SQL = with_(POINTS, f"""
ex AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS x FROM points WHERE label <> -1),
cm AS (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), {CENTER_DIGITS}) AS m FROM ex GROUP BY label, pos),
cents AS (SELECT label, list(m ORDER BY pos) AS center FROM cm GROUP BY label),
dd AS (SELECT p.row_id, c.label AS cid,
              sqrt(list_reduce(list_transform(list_zip(p.embedding, c.center), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])), lambda a, b: a + b)) AS d
       FROM points p CROSS JOIN cents c),
md AS (SELECT row_id, d AS min_dist, cid AS nearest FROM
         (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, cid) AS rn FROM dd) WHERE rn = 1)
""")


def label_centers(spark, sf_dir):
    c = centroids(points(spark, sf_dir), "label")
    return c.select("label", F.transform("center", lambda x: F.round(x, CENTER_DIGITS)).alias("center"))


@query("centroid_by_label", oracle=CENT_SQL + "SELECT label, list_transform(center, lambda x: round(x, 6)) AS center FROM cents")
def q_centroids(spark, sf_dir):
    """Mean vector per label (noise excluded)."""
    return label_centers(spark, sf_dir).select("label", _r6(F.col("center")).alias("center"))


def _min_dist(spark, sf_dir):
    return min_distance(points(spark, sf_dir), label_centers(spark, sf_dir), "label")


@query("min_dist_centers", oracle=CENT_SQL + "SELECT row_id, round(min_dist, 6) AS min_dist, nearest FROM md")
def q_min_dist(spark, sf_dir):
    """J5 + A8 + T9: distance to, and id of, the nearest centroid."""
    return _min_dist(spark, sf_dir).select("row_id", F.round("min_dist", 6).alias("min_dist"), "nearest")


@query("coverage_radius", oracle=CENT_SQL + "SELECT round(max(min_dist), 6) AS radius FROM md")
def q_coverage_radius(spark, sf_dir):
    """A9."""
    return coverage_radius(_min_dist(spark, sf_dir)).select(F.round("radius", 6).alias("radius"))


@query("farthest_point", oracle=CENT_SQL + "SELECT row_id, round(min_dist, 6) AS min_dist FROM md ORDER BY min_dist DESC, row_id LIMIT 1")
def q_farthest_point(spark, sf_dir):
    """The point farthest from every centroid (ties: smallest id)."""
    return farthest_point(_min_dist(spark, sf_dir)).select("row_id", F.round("min_dist", 6).alias("min_dist"))


def _bucket_sql(x: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT) % 64 AS INTEGER)"


POOL_CTES = f"""s AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\\n]+[.!?]*'), lambda x: {strip("x")}), lambda x: x <> '') AS sents
  FROM documents),
v AS (
  SELECT doc_id, list_transform(sents, lambda st: list_transform(range(0, 64), lambda i:
           CAST(len(list_filter(list_transform({tok("st")}, lambda w: {_bucket_sql("w")}), lambda b: b = i)) AS DOUBLE))) AS vecs
  FROM s),
m AS (
  SELECT doc_id, CASE WHEN len(vecs) > 0 THEN list_transform(
           list_reduce(vecs, lambda a, b: list_transform(list_zip(a, b), lambda p: p[1] + p[2])),
           lambda x: x / len(vecs)) END AS mv FROM v),
pv AS (
  SELECT doc_id AS row_id, CASE WHEN {NRM("mv")} > 0 THEN list_transform(mv, lambda x: x / {NRM("mv")}) END AS vec
  FROM m)"""

MEAN_POOL_SQL = "WITH " + POOL_CTES + """
SELECT row_id, list_transform(vec, lambda x: round(x, 6)) AS vec FROM pv"""


@query("mean_pool", oracle=MEAN_POOL_SQL)
def q_mean_pool(spark, sf_dir):
    """X8 front end: sentences (E8) -> hashed sentence vectors (M1) -> mean pool (A6) -> L2."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), _r6(pooled_vector(F.col("text"))).alias("vec"))
