-- name: tier_assign
SELECT u.condition_id, R(depth_usd) AS depth_usd,
  CASE WHEN venue <> 'kalshi' AND (order_book = 0 OR k % 40 IN (0, 1)) THEN 'ignored'
       WHEN depth_usd >= 250 THEN 'liquid' WHEN depth_usd >= 10 THEN 'tail' WHEN depth_usd IS NOT NULL THEN 'ignored'
       WHEN venue = 'kalshi' THEN CASE WHEN volume_num >= 5000 AND open_interest >= 100 THEN 'liquid' ELSE 'tail' END
       WHEN liquidity_num >= 100000 AND volume_num >= 1000000 THEN 'liquid'
       WHEN liquidity_num >= 1000 AND volume_num >= 5000 THEN 'tail' ELSE 'ignored' END AS tier,
  CASE WHEN venue <> 'kalshi' AND order_book = 0 THEN 'no_orderbook' WHEN venue <> 'kalshi' AND k % 40 IN (0, 1) THEN 'crypto_price_target'
       WHEN depth_usd < 10 THEN 'low_liquidity'
       WHEN depth_usd IS NULL AND venue <> 'kalshi' AND NOT (liquidity_num >= 1000 AND volume_num >= 5000) THEN 'low_liquidity' END AS reason
FROM fx_universe u LEFT JOIN fx_latest q ON q.condition_id = u.condition_id

-- name: exclusion_flags
SELECT condition_id, array_to_string(reasons, ',') AS reasons FROM fx_reasons

-- name: exclusion_log
SELECT venue, venue_native_id, reason, DAYNUM(ts_s) AS day, min(ts_s) AS ts_s FROM (
  SELECT venue, condition_id AS venue_native_id, unnest(reasons) AS reason, EPOCH(l_shipdate) + 3600 * l_linenumber AS ts_s
  FROM fx_reasons JOIN lineitem ON l_orderkey = k) GROUP BY ALL

-- name: category_map
SELECT t.condition_id, coalesce(arg_min(x.category, x.priority), 'unknown') AS category
FROM fx_tags t LEFT JOIN fx_taxonomy x ON x.raw_tag = t.raw_tag GROUP BY t.condition_id

-- name: category_drift
SELECT raw_tag, count(*) AS n FROM fx_tags WHERE raw_tag NOT IN (SELECT raw_tag FROM fx_taxonomy) GROUP BY raw_tag

-- name: event_from_key
SELECT condition_id, coalesce(event_id, concat(venue, ':', string_split(venue_native_id, '-')[1], '-', string_split(venue_native_id, '-')[2])) AS event_id
FROM fx_universe

-- name: event_link
WITH nodes AS (
  SELECT concat('m', o_orderkey) AS node, o_custkey // 10 AS g FROM orders
  UNION SELECT concat('c', o_custkey), o_custkey // 10 FROM orders
  UNION SELECT concat('c', c_custkey), c_custkey // 10 FROM customer
  UNION SELECT concat('g', c_custkey // 10), c_custkey // 10 FROM customer),
lead AS (SELECT g, min(node) AS label FROM nodes GROUP BY g),
known AS (SELECT o_custkey // 10 AS g, min(concat('old', o_custkey)) AS event_id FROM orders WHERE o_custkey // 10 % 2 = 0 GROUP BY 1)
SELECT n.node AS condition_id, coalesce(k.event_id, concat('evt_', substr(sha256(l.label), 1, 16))) AS event_id
FROM nodes n JOIN lead l ON l.g = n.g LEFT JOIN known k ON k.g = n.g

-- name: eligible_states
SELECT condition_id, venue, tier, category, R(mid) AS p_market, R(spread) AS spread, quote_s, R(days_to_resolution) AS days_to_resolution,
  R(depth_usd) AS depth_usd FROM fx_screened WHERE reason IS NULL

-- name: eligibility_rejects
SELECT venue, reason, count(*) AS n FROM fx_screened WHERE reason IS NOT NULL GROUP BY ALL

-- name: due_filter
WITH last AS (SELECT condition_id, model_id, max(ts_s) AS last_s FROM fx_forecasts WHERE ts_s <= 915220800 GROUP BY ALL),
moves AS (SELECT concat('m', l_orderkey) AS condition_id, max(l_discount) * 4 - 2e-1 AS move FROM lineitem GROUP BY ALL),
pairs AS (SELECT condition_id, unnest(['m0_market', 'm1_debiased', 'm2_baserate', 'm3_evidence', 'm4_ensemble', 'm5_nowcast', 'm7_crossvenue']) AS model_id
  FROM fx_screened WHERE reason IS NULL)
SELECT p.condition_id, p.model_id, l.last_s FROM pairs p LEFT JOIN last l ON l.condition_id = p.condition_id AND l.model_id = p.model_id
LEFT JOIN moves m ON m.condition_id = p.condition_id
WHERE last_s IS NULL OR 915220800 - last_s >= 86400 OR (DAYNUM(915220800) - DAYNUM(last_s) >= 1 AND 915220800 - last_s >= 21600)
  OR (abs(move) > 1e-1 AND 915220800 - last_s >= 21600)

-- name: price_move_24h
WITH q AS (SELECT * FROM fx_snapshots WHERE ts_s BETWEEN 1704067200 + 13 * 86400 AND 1704067200 + 15 * 86400 + 43200)
SELECT condition_id, R(arg_max(mid, ts_s) - arg_max(mid, ts_s) FILTER (ts_s <= 1704067200 + 14 * 86400 + 43200)) AS move
FROM q GROUP BY condition_id HAVING count(*) FILTER (ts_s <= 1704067200 + 14 * 86400 + 43200) > 0

-- name: bottom_k_sample
SELECT venue, condition_id, rank FROM (SELECT venue, condition_id,
  row_number() OVER (PARTITION BY venue ORDER BY sha256(concat_ws(':', '42', venue, condition_id)), condition_id) AS rank FROM fx_markets)
WHERE rank <= 150

-- name: sample_guard
SELECT category, count(*) AS n, min(condition_id) AS first_id FROM fx_universe
WHERE condition_id NOT IN (SELECT condition_id FROM fx_outside) GROUP BY category

-- name: control_members
SELECT DISTINCT venue, condition_id FROM fx_forecasts WHERE category = 'sports'

-- name: rank_candidates
SELECT condition_id, category, R(liquidity_num) AS liquidity_num, rank FROM fx_ranked WHERE rank <= 120

-- name: boundary_randomize
SELECT condition_id, rank, randomized FROM (
  SELECT condition_id, rank, CASE WHEN rank > 110 THEN 1 ELSE 0 END AS randomized,
    row_number() OVER (PARTITION BY rank > 110 ORDER BY sha256(concat('43:', condition_id))) AS b FROM fx_ranked WHERE rank <= 130)
WHERE randomized = 0 OR b <= 10

-- name: topic_candidates
WITH top AS (SELECT *, coalesce(event_id, condition_id) AS cluster_id FROM fx_universe WHERE tier = 'liquid' AND active = 1
    AND category IN ('economics', 'weather', 'politics', 'geopolitics', 'entertainment')
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY volume_num DESC, condition_id) <= 40),
one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY category, cluster_id ORDER BY volume_num DESC, condition_id) = 1)
SELECT * FROM (SELECT category, row_number() OVER (PARTITION BY category ORDER BY volume_num DESC, condition_id) AS slot, condition_id, cluster_id FROM one)
WHERE slot <= 8

-- name: watch_candidates
SELECT condition_id, checked_s FROM fx_universe WHERE venue = 'polymarket'
  AND (closed = 1 OR end_s < 915220800 OR last_synced_s < 915220800 - 86400)
  AND condition_id NOT IN (SELECT condition_id FROM fx_resolutions)
ORDER BY checked_s ASC NULLS FIRST, condition_id LIMIT 1000
