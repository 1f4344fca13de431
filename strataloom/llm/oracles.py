"""SQL twins, in DuckDB's dialect, of the operators that SQL can express. They compare all pairs that share a shingle."""

from __future__ import annotations

from . import secrets

_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _shingles(size: int) -> str:
    parts = " || chr(10) || ".join(f"w[i + {k}]" for k in range(size))
    return f"CASE WHEN len(w) >= {size} THEN list_distinct([{parts} FOR i IN range(1, len(w) - {size - 2})]) WHEN len(w) > 0 THEN [array_to_string(w, chr(10))] ELSE [] END"


def _components(size: int, num: int, den: int) -> str:
    """From u(id, w): sizes n(id, n), links and comp(id, c) as common table expressions."""
    return f"""
sets AS (SELECT id, {_shingles(size)} AS s FROM u),
g AS (SELECT id, unnest(s) AS g FROM sets),
n AS (SELECT id, len(s) AS n FROM sets),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE {den} * c >= {num} * (p.n + q.n - c)),
reach AS (SELECT id AS x, id AS y FROM u UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS id, min(y) AS c FROM reach GROUP BY 1)"""


OP2 = f"""WITH RECURSIVE u AS (SELECT doc_id AS id, {_WORDS.format(_LOWERED.format('text'))} AS w FROM documents), {_components(3, 85, 100)}
SELECT id AS doc_id, n AS n_shingles, c AS component_id, id = c AS kept FROM n JOIN comp USING (id)"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
unit AS (SELECT vec_id, [x / sqrt(list_inner_product(e, e)) FOR x IN e] AS e FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9::DOUBLE),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x AS vec_id, min(y) AS c FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM comp"""


def _kind(k: int) -> str:
    name, pattern, group, least, _ = secrets.KINDS[k]
    p = pattern.replace("'", "''")
    secret = f"regexp_extract(hits[i], '{p}', {group})" if group else "hits[i]"
    return f"""SELECT row, owner, repository, {k} AS kind, '{name}' AS name, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS BIGINT) AS b, length(hits[i]) AS size, {secret} AS secret
FROM (SELECT row, owner, repository, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT row, owner, repository, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM docs_)) WHERE length({secret}) >= {least}"""


OP5 = f"""WITH docs_ AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(f'({_kind(k)})' for k in range(len(secrets.KINDS)))}),
judged AS (SELECT found.*, name || ':' || b || ':' || (b + size) AS span, live FROM found JOIN (SELECT secret, count(DISTINCT owner) < {secrets.WIDE_OWNERS} AND count(DISTINCT repository) < {secrets.WIDE_REPOSITORIES} AS live FROM found GROUP BY 1) USING (secret))
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{secrets.BASE[k][0]}" for k in range(len(secrets.BASE)))},
  sha256(coalesce(string_agg(span, ',' ORDER BY b, kind) FILTER (kind < {len(secrets.BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY b, kind) FILTER (kind < {len(secrets.BASE)} OR live), '') AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM docs_ d LEFT JOIN judged j USING (row) GROUP BY row, d.doc_id"""
