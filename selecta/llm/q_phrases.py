"""Query of phrase collocations."""

from __future__ import annotations

from selecta.llm import collocations
from selecta.llm.queries import query
from selecta.sources.tables import read_table


@query("op11_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
     i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
     g AS (SELECT lang, words[i:i + m - 1] AS g, m FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(words)),
     f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
     n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
     c AS (SELECT f.lang, f.phrase, f.m, f.f AS a, k, x.f AS l, y.f AS r, (2000000 * f.f) // (x.f + y.f) AS score
           FROM f JOIN (SELECT unnest([1, 2, 3]) AS k) k ON k.k < f.m
           JOIN f x ON x.lang = f.lang AND x.m = k.k AND x.phrase = array_to_string(f.g[1:k.k], ' ')
           JOIN f y ON y.lang = f.lang AND y.m = f.m - k.k AND y.phrase = array_to_string(f.g[k.k + 1:], ' ')),
     b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     d AS (SELECT lang, array_to_string(g[i:i + j - 1], ' ') AS sub, max(f) AS around
           FROM f, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
     s AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM b LEFT JOIN d ON d.lang = b.lang AND d.sub = b.phrase WHERE d.around IS NULL OR 100 * d.around < 80 * b.a)
SELECT s.lang, s.rank, s.phrase, CAST(s.a AS BIGINT) AS a, CAST(s.l AS BIGINT) AS l, CAST(s.r AS BIGINT) AS r, n.n, CAST(s.score AS BIGINT) AS score
FROM s JOIN n USING (lang) WHERE s.rank <= 2000""")
def op11(spark, sf_dir):
    """The best 2,000 phrases of two to four words of every language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
