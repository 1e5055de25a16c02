-- name: quote_etl
WITH e AS (SELECT event_id AS k, user_id, event_id % 90 + 4 AS p, CASE WHEN user_id % 2 = 0 THEN 'polymarket' ELSE 'kalshi' END AS venue, concat('s', user_id) AS condition_id FROM events),
q AS (SELECT *, k % 13 = 0 AS bad, p / 100e0 AS b, CASE WHEN k % 11 <> 0 THEN (p + 2) / 100e0 END AS a FROM e),
r AS (SELECT venue, condition_id, CASE WHEN bad THEN 'unreadable' WHEN venue = 'polymarket' AND a IS NULL THEN 'no_price' WHEN a IS NULL AND k % 17 = 0 THEN 'no_price' END AS reject_reason,
  CASE WHEN NOT bad THEN b END AS best_bid, CASE WHEN NOT bad THEN a END AS best_ask,
  CASE WHEN bad THEN NULL WHEN a IS NOT NULL THEN (a + b) / 2 WHEN venue = 'kalshi' AND k % 17 <> 0 THEN (p + 1) / 100e0 END AS mid,
  CASE WHEN NOT bad THEN a - b END AS spread,
  CASE WHEN bad THEN NULL WHEN venue = 'polymarket' THEN b * (13 + k % 7) WHEN k % 5 > 0 THEN b * (k % 5) END AS bid_depth,
  CASE WHEN bad THEN NULL WHEN venue = 'polymarket' THEN a * 8 WHEN k % 3 <> 0 THEN a * 40 END AS ask_depth,
  CASE WHEN bad THEN NULL WHEN venue = 'polymarket' THEN 3 ELSE 1 END AS bid_levels,
  CASE WHEN bad THEN NULL WHEN venue = 'polymarket' THEN a ELSE (p + 2) / 100e0 END AS top_ask FROM q)
SELECT venue, condition_id, reject_reason, count(*) AS n, R(sum(best_bid)) AS best_bid, R(sum(best_ask)) AS best_ask, R(sum(mid)) AS mid, R(sum(spread)) AS spread,
  R(sum(bid_depth)) AS bid_depth_usd, R(sum(ask_depth)) AS ask_depth_usd, I(sum(bid_levels)) AS bid_levels, R(sum(top_ask)) AS top_ask FROM r GROUP BY ALL

-- name: market_etl
WITH v AS (SELECT *, CASE venue WHEN 'metaculus' THEN 'manifold' ELSE venue END AS vn FROM fx_universe),
n AS (SELECT *, CASE vn WHEN 'polymarket' THEN CASE WHEN k % 101 <> 0 THEN condition_id END WHEN 'kalshi' THEN venue_native_id ELSE cast(k AS varchar) END AS native,
  CASE WHEN vn = 'polymarket' AND (k % 13 = 0 OR k % 17 = 0) THEN 0 ELSE 1 END AS bin FROM v)
SELECT vn AS venue, native AS venue_native_id, CASE WHEN vn = 'polymarket' THEN native ELSE concat(vn, ':', native) END AS condition_id,
  CASE vn WHEN 'manifold' THEN 'unknown' ELSE coalesce(category, 'unknown') END AS category,
  CASE WHEN vn = 'kalshi' AND k % 3 = 0 THEN NULL ELSE end_s END AS end_s, CASE WHEN vn = 'polymarket' AND bin = 1 THEN 't2' END AS token_id_no,
  CASE vn WHEN 'polymarket' THEN neg_risk ELSE 0 END AS neg_risk,
  CASE vn WHEN 'kalshi' THEN CASE WHEN closed = 0 AND k % 5 <> 1 THEN 1 ELSE 0 END ELSE active END AS active, closed,
  R(CASE WHEN vn <> 'polymarket' THEN volume_num END) AS volume_num, bin AS is_binary,
  CASE WHEN native IS NULL THEN 'no_key' WHEN bin = 0 THEN 'non_binary' END AS reject_reason FROM n

-- name: payout_etl
WITH u AS (SELECT * FROM fx_universe),
p AS (SELECT venue, CASE venue WHEN 'polymarket' THEN condition_id WHEN 'kalshi' THEN concat('kalshi:', venue_native_id) ELSE concat('metaculus:', k) END AS condition_id,
  CASE WHEN venue = 'polymarket' AND closed = 1 AND k % 6 <> 1 AND k % 11 <> 0 THEN CASE k % 6 WHEN 2 THEN 0e0 ELSE 1e0 END
       WHEN venue = 'kalshi' AND closed = 1 AND k % 7 <> 0 AND k % 2 = 0 THEN CASE k % 8 WHEN 0 THEN 1e0 ELSE 0e0 END
       WHEN venue = 'metaculus' THEN CASE k % 7 WHEN 1 THEN 1e0 WHEN 2 THEN 0e0 WHEN 3 THEN 1e0 END END AS payout_yes,
  CASE WHEN venue = 'polymarket' AND k % 11 IN (0, 1) THEN 1 ELSE 0 END AS disputed,
  CASE WHEN venue = 'polymarket' AND k % 5 IN (0, 1) THEN end_s END AS venue_resolved_s,
  (venue IN ('polymarket', 'kalshi') AND closed = 0) OR (venue = 'metaculus' AND k % 7 IN (5, 6)) AS still_open, venue = 'polymarket' AND k % 11 = 0 AS pending FROM u)
SELECT venue, condition_id, payout_yes, disputed, venue_resolved_s, CASE WHEN payout_yes IS NOT NULL THEN NULL WHEN still_open THEN 'open' WHEN pending THEN 'dispute_open' ELSE 'not_binary' END AS reject_reason FROM p

-- name: stream_snapshots
SELECT quote_id, condition_id, ts_s, R(mid) AS mid FROM fx_snapshots

-- name: stream_latest
SELECT concat('s', user_id) AS condition_id, EPOCH(ts) AS ts_s, R(least(98e-2, 2e-2 + 96e-2 * (value / 500e0))) AS mid FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY EPOCH(ts) DESC, event_id DESC) = 1

-- name: stream_coverage
WITH q AS (SELECT event_id % 3 AS batch, EPOCH(ts) AS ts_s, EPOCH(ts) - EPOCH(ts) % 900 AS bucket_s,
    CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_acctbal >= 5000 THEN 'liquid' WHEN c_acctbal >= 0 THEN 'tail' ELSE 'ignored' END AS tier
  FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 9 <> 0) ON c_custkey = user_id),
b AS (SELECT batch, max(ts_s) AS newest_s FROM q GROUP BY 1)
SELECT tier, bucket_s, count(*) AS n,
    I(count_if(coalesce(bucket_s + 900 <= (SELECT max(newest_s) - 3600 FROM b WHERE b.batch < q.batch), false))) AS late,
    bucket_s <= (SELECT max(newest_s) - 3600 - 900 FROM b) AS closed
FROM q GROUP BY tier, bucket_s

-- name: stream_resolutions
SELECT model_id, cat AS category, forecast_id, R(sum(delta) OVER w) AS cum_log_wealth, row_number() OVER w AS n_forecasts FROM fx_delta
WINDOW w AS (PARTITION BY model_id, cat ORDER BY cast(substr(condition_id, 2) AS bigint) % 3, entry_s, ts_s, forecast_id ROWS UNBOUNDED PRECEDING)
