-- name: question_spec
WITH q AS (SELECT concat('q', k) AS condition_id, CASE WHEN k % 2 = 0 THEN concat('Will the high temperature in ',
    ['New York', 'Chicago', 'Springfield', 'Los Angeles', 'Denver', 'Paris'][k % 6 + 1], ' be ', ['above', 'below', 'exceed', 'under', ''][k % 5 + 1], ' ', k % 120 - 10,
    CASE k % 4 WHEN 0 THEN '°F' WHEN 2 THEN ' degrees Celsius' ELSE '' END, '?')
  ELSE concat(CASE k % 3 WHEN 0 THEN 'Will GDP growth print ' WHEN 1 THEN 'Will PCE inflation come in ' ELSE 'Will the score be ' END,
    CASE WHEN k % 7 < 3 THEN 'below ' ELSE 'above ' END, k % 9, '.', k % 10, '% this quarter?') END AS question, k FROM (SELECT c_custkey AS k FROM customer))
SELECT condition_id, question, CASE WHEN k % 2 = 0 THEN 'weather' ELSE 'macro' END AS kind,
  CASE WHEN k % 2 = 0 THEN lower(['New York', 'Chicago', 'Springfield', 'Los Angeles', 'Denver', 'Paris'][k % 6 + 1]) END AS city,
  CASE WHEN k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN 'GDPNOW' ELSE 'PCENOW' END END AS series,
  R(CASE WHEN k % 2 = 0 THEN cast(k % 120 - 10 AS double) ELSE (k % 9) + (k % 10) / 10e0 END) AS threshold,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 4 = 2 THEN 'celsius' ELSE 'fahrenheit' END END AS unit,
  CASE WHEN k % 2 = 0 THEN CASE WHEN k % 5 IN (0, 2, 4) THEN 1 ELSE 0 END ELSE CASE WHEN k % 7 < 3 THEN 0 ELSE 1 END END AS above
FROM q WHERE (k % 2 = 0 AND k % 6 NOT IN (2, 5)) OR (k % 2 = 1 AND k % 3 <> 2)

-- name: keyword_match
WITH keys AS (SELECT concat('b', item_id) AS condition_id, unnest(list_distinct(list_slice(list_filter(list_transform(
    regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]+'), lambda w : lower(w)), lambda w : NOT list_contains(['will', 'the', 'a', 'an', 'by', 'in', 'on', 'at', 'of', 'to', 'be', 'is',
    'before', 'after', 'than', 'or', 'and', 'for', 'with', 'does', 'do'], w)), 1, 8))) AS token FROM benchmark),
titles AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9''-]+'))) AS token FROM documents),
hits AS (SELECT DISTINCT condition_id, doc_id AS article_id FROM keys k JOIN titles t ON t.token = k.token)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY article_id) AS rank FROM hits) WHERE rank <= 20

-- name: article_dedup
SELECT url, page_id, feed FROM (SELECT url, page_id, 1 AS feed FROM pages UNION ALL SELECT regexp_extract(url, '^[^?#]*'), page_id, 2 FROM pages)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, page_id) = 1

-- name: asof_articles
SELECT condition_id, published_s, end_s - 2592000 AS forecast_s, count(*) AS n FROM (
  SELECT l_orderkey, CASE WHEN l_partkey % 9 <> 0 THEN EPOCH(l_shipdate) END AS published_s FROM lineitem) JOIN fx_markets ON k = l_orderkey
WHERE published_s IS NULL OR published_s <= end_s - 2592000 GROUP BY ALL

-- name: evidence_etl
WITH r AS (SELECT l_orderkey AS k, l_partkey % 50 <> 0 AND l_partkey % 5 <> 2 AND l_partkey % 23 <> 0 AS good,
    (1 + l_linenumber % 3) * (1 + l_suppkey % 3) + 1 + l_partkey % 3 AS grade FROM lineitem)
SELECT k, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected, 2 * count(*) FILTER (good) AS n_items,
  I(coalesce(sum(grade) FILTER (good), 0)) AS grade FROM r GROUP BY k

-- name: lessons_digest
SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE concat('source', o_orderkey % 6) END AS error_source, count(*) AS n FROM orders
WHERE EPOCH(o_orderdate) >= 883612800 AND o_custkey % 3 <> 0 AND o_orderkey % 31 NOT IN (0, 1) GROUP BY 1

-- name: lessons_notes
SELECT o_orderkey AS postmortem_id, concat('[', CASE o_custkey % 3 WHEN 0 THEN 'hit' ELSE 'miss' END, '] note ', o_orderkey) AS note FROM orders
WHERE EPOCH(o_orderdate) >= 883612800 AND o_orderkey % 31 NOT IN (0, 1) AND (o_orderkey % 9 = 0 OR o_orderkey % 4 = 0)

-- name: pair_candidates
WITH a AS (SELECT item_id AS a_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM benchmark),
b AS (SELECT doc_id AS b_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents),
x AS (SELECT a_id, b_id, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS na, len(b.t) AS nb FROM a, b)
SELECT a_id, b_id, R(i / (na + nb - i)) AS score FROM x WHERE i / (na + nb - i) >= 4e-1 AND na > 0 AND nb > 0
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b_id AND l.doc_id % 40 = a_id)
