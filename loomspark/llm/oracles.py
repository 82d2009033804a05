"""DuckDB statements for the training-data queries that SQL can express."""
from __future__ import annotations

LLM_ORACLES: dict[str, str] = {}

LLM_ORACLES["op2_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

LLM_ORACLES["op7_url_lists"] = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS d,
         nullif(lower(regexp_replace(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.+$', '')), '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
names AS (
  SELECT 'host' AS kind, host AS value, 3 AS m FROM p UNION
  SELECT 'domain', regexp_replace(host, '^[^.]+\.', ''), 2 FROM p UNION
  SELECT 'prefix', host || '/' || lower(regexp_extract(path, '^/([^/]+)', 1)), 4 FROM p
  WHERE regexp_extract(path, '^/([^/]+)', 1) <> ''),
hashed AS (
  SELECT kind, value, CAST('0x' || substr(md5(value), 1, 6) AS INTEGER) AS h, m FROM names WHERE value IS NOT NULL),
events AS (
  SELECT kind || ':' || lower(value) AS key, DATE '2024-01-01' + CAST((h // 16) % 300 + x.off AS INTEGER) AS t, x.action
  FROM hashed, (VALUES ('add', 0), ('remove', 45), ('add', 90)) x(action, off) WHERE h % m = 0),
ranges AS (
  SELECT key, t AS since, lead(t) OVER (PARTITION BY key ORDER BY t) AS until, action FROM events),
keys AS (
  SELECT page_id, d, 'host:' || host AS k FROM p WHERE host IS NOT NULL UNION
  SELECT page_id, d, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
  FROM p, range(1, 40) r(i) WHERE host IS NOT NULL AND i <= len(string_split(host, '.')) UNION
  SELECT page_id, d, 'prefix:' || host || '/' || lower(list_filter(string_split(path, '/'), lambda s: s <> '')[1])
  FROM p WHERE host IS NOT NULL AND len(list_filter(string_split(path, '/'), lambda s: s <> '')) > 0),
hits AS (
  SELECT keys.page_id, list(DISTINCT r.key) AS found FROM keys JOIN ranges r
  ON r.key = keys.k AND r.action = 'add' AND keys.d >= r.since AND (r.until IS NULL OR keys.d < r.until)
  GROUP BY keys.page_id)
SELECT p.page_id, p.host, strftime(p.d, '%Y-%m-%d') AS fetched_at, hits.found IS NOT NULL AS blocked,
       coalesce(len(hits.found), 0) AS n_active, coalesce(array_to_string(list_sort(hits.found), ','), '') AS entries
FROM p LEFT JOIN hits USING (page_id)
"""

LLM_ORACLES["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, y.id, a.label = y.label AS same, CAST(list_inner_product(a.e, y.e) AS BIGINT) AS score
  FROM v a, v y WHERE a.id % 100 = 0 AND a.id <> y.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
