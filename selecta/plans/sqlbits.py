"""DuckDB text for the oracles: the fixture views as CTEs and expression helpers."""

from __future__ import annotations

INSTR = """instr AS (
  SELECT doc_id AS row_id, coalesce(l[1], '') AS instruction, nullif(l[2], '') AS input,
         array_to_string(l[3:], chr(10)) AS output, source
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""

PAIRS = """pairs AS (
  SELECT u.conv_id * 100 + u.turn AS row_id, u.text AS instruction, y.text AS input, a.text AS output
  FROM conversations u
  JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations y ON y.conv_id = u.conv_id AND y.role = 'system'
  WHERE u.role = 'user')"""

PREDS = PAIRS + """,
ptok AS (SELECT row_id, output, list_filter(regexp_split_to_array(output, '[ \\t\\n\\r]+'), lambda t: t <> '') AS tk FROM pairs),
preds AS (
  SELECT p.row_id, CAST(d.seed AS INTEGER) AS seed, p.output AS gt,
         CASE WHEN p.output IS NOT NULL THEN array_to_string(list_transform(list_sort(list_filter(list_transform(range(0, len(tk)), lambda i:
           {'k': (i // 3) * 3 + 2 - i % 3,
            'h': CAST(('0x' || substr(md5(concat(d.seed, ':', p.row_id, ':', i)), 1, 2)) AS INTEGER), 't': tk[i + 1]}),
           lambda x: x.h >= d.drp)), lambda x: CASE WHEN x.h < d.drp + d.swp THEN 'xx' ELSE x.t END), ' ') END AS pred
  FROM ptok p CROSS JOIN (VALUES (2021, 20, 40), (2022, 30, 20), (2023, 10, 10)) d(seed, drp, swp))"""

MULTI = """multi AS (
  SELECT doc_id AS row_id, coalesce(l[1], '') AS prompt, coalesce(l, []) AS responses
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

POINTS = """points AS (SELECT vec_id AS row_id, embedding, label FROM embeddings)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


#: ROUGE-L of every prediction: rl (row_id, seed, f, p, r). The recursion goes
#: through the anti-diagonals of the dynamic programme; a cell needs only the two
#: diagonals before its own.
ROUGE_L = """
lt AS (SELECT row_id, seed, list_filter(regexp_split_to_array(coalesce(pred, ''), '[ \\t\\n\\r]+'), lambda t: t <> '') AS h,
              list_filter(regexp_split_to_array(coalesce(gt, ''), '[ \\t\\n\\r]+'), lambda t: t <> '') AS g FROM preds),
lcs AS (
  SELECT row_id, seed, h, g, 1 AS d, list_transform(range(0, len(h) + 1), lambda i: 0) AS cur,
         list_transform(range(0, len(h) + 1), lambda i: 0) AS prev FROM lt
  UNION ALL
  SELECT row_id, seed, h, g, d + 1, list_transform(range(0, len(h) + 1), lambda i:
           CASE WHEN i = 0 OR d + 1 - i <= 0 OR d + 1 - i > len(g) THEN 0
                WHEN h[i] = g[d + 1 - i] THEN prev[i] + 1 ELSE greatest(cur[i], cur[i + 1]) END), cur
  FROM lcs WHERE d < len(h) + len(g)),
ll AS (SELECT row_id, seed, len(h) AS m, len(g) AS n, CAST(cur[len(h) + 1] AS DOUBLE) AS l FROM lcs WHERE d = greatest(len(h) + len(g), 1)),
lp AS (SELECT row_id, seed, CASE WHEN m > 0 THEN l / m ELSE 0.0 END AS p, CASE WHEN n > 0 THEN l / n ELSE 0.0 END AS r FROM ll),
rl AS (SELECT row_id, seed, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM lp)"""


def recursive(sql: str) -> str:
    """A statement whose CTEs may refer to themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def tok(x: str) -> str:
    """Whitespace tokens of x, empties dropped."""
    return f"list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda t: t <> '')"


def bigr(x: str) -> str:
    t = tok(x)
    return (f"(CASE WHEN len({t}) < 2 THEN []::VARCHAR[] ELSE "
            f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]) END)")


def ngr(x: str, n: int) -> str:
    if n == 1:
        return tok(x)
    if n == 2:
        return bigr(x)
    t = tok(x)
    return (f"(CASE WHEN len({t}) < {n} THEN []::VARCHAR[] ELSE "
            f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' ')) END)")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def md5key(seed: int, idcol: str = "row_id") -> str:
    return f"md5(concat('{int(seed)}', ':', CAST({idcol} AS VARCHAR)))"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"
