"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from .licenses import GAP, GRAM, LEAST_SHARE, templates

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(split: str) -> str:
    return rf"""
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{split}'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d)"""


NEAR_DUP = (
    "WITH RECURSIVE"
    + _words(r"[\x20\x09-\x0D]+")
    + """,
v AS (SELECT doc_id, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
s AS (SELECT DISTINCT doc_id, x || ' ' || y || ' ' || z AS g FROM v WHERE z IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM c JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT doc_id AS i, doc_id AS j FROM d UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
m AS (SELECT i AS doc_id, min(j) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id FROM n JOIN m USING (doc_id)
"""
)

NEAR_LINKS = NEAR_DUP.replace("n AS n_shingles, component_id", "n AS n_shingles, (SELECT count(*) FROM e WHERE e.i = n.doc_id) AS n_links, component_id")


def _licenses() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [(name, label, k, i, len(w) - k + 1, len(w), " ".join(w[i : i + k])) for name, label, k, w in templates() for i in range(len(w) - k + 1)]
    values = ", ".join(f"({quoted(t)}, {quoted(lab)}, {k}, {i}, {g}, {n}, {quoted(x)})" for t, lab, k, i, g, n, x in rows)
    return (
        "WITH"
        + _words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        + f""",
v AS (SELECT doc_id, p, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
t AS (SELECT * FROM (VALUES {values}) t(template, label, k, place, n_grams, n_template, gram)),
hit AS (SELECT DISTINCT doc_id, template, label, k, n_grams, place, p - place AS diagonal FROM v JOIN t ON (k = 2 AND gram = x || ' ' || x1) OR (k = {GRAM} AND gram = x || ' ' || x1 || ' ' || x2 || ' ' || x3)),
base AS (SELECT doc_id, label, diagonal FROM hit WHERE k = 2 GROUP BY doc_id, template, label, n_grams, diagonal HAVING count(*) = n_grams),
g0 AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS fresh FROM hit WHERE k = {GRAM}),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE UNBOUNDED PRECEDING) AS grp FROM g0),
text AS (SELECT doc_id, label, count(DISTINCT place) / n_grams AS share FROM g1 GROUP BY doc_id, template, label, n_grams, grp HAVING count(DISTINCT place) / n_grams >= {LEAST_SHARE}),
alls AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT doc_id, label, share FROM text),
b AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM alls GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
    )


LICENSES = _licenses()
