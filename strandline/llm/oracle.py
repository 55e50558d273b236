"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from strandline.llm.urls import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id), s.doc_id)) AS component_id
FROM s
"""

_VALUES = ", ".join(f"('{action}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for action, rule in RULES)
URLS = rf"""
WITH rules(action, rule, rule_host, rule_path) AS (VALUES {_VALUES}), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM split LEFT JOIN LATERAL (
  SELECT rule, action FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  ORDER BY length(rule) DESC LIMIT 1) best ON true
"""
