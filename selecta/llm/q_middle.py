"""Query of the fill-in-middle transformation."""

from __future__ import annotations

from selecta.llm import fill_in_middle
from selecta.llm.queries import query
from selecta.sources.tables import read_table


def _h(i: int) -> str:
    return f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT)"


@query("op13_fill_in_middle", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
     u AS (SELECT doc_id, text, {_h(0)} AS h1, {_h(1)} AS h2, {_h(2)} AS h3, {_h(3)} AS h4,
                  regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM d),
     c AS (SELECT *, len(units) AS n, CAST(least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS one,
                  CAST(greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS BIGINT) AS two,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                       THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT *, array_to_string(units[1:one], '') AS a, array_to_string(units[one + 1:two], '') AS m,
                  array_to_string(units[two + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
                        ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op13(spark, sf_dir):
    """Every document as a fill-in-middle sample, digested, and rebuilt from the sample."""
    return fill_in_middle.digests(fill_in_middle.transformed(read_table(spark, sf_dir, "documents")))
