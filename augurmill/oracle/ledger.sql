-- name: ts_bucket
SELECT forecast_id, ts_s - ts_s % 300 AS b5, ts_s - ts_s % 3600 AS b60, ts_s - ts_s % 14400 AS b240 FROM fx_priced

-- name: snapshot_dedup
SELECT quote_id, condition_id, ts_s, R(mid) AS mid FROM fx_snapshots

-- name: snapshot_append
SELECT strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d') AS date, cast(ts_s % 86400 // 3600 AS integer) AS hour, count(*) AS n, I(sum(quote_id)) AS sum_quote_id
FROM fx_snapshots WHERE ts_s >= 1704067200 + 18 * 86400 GROUP BY ALL

-- name: snapshot_read
SELECT condition_id, ts_s, R(mid) AS mid, cast(NULL AS double) AS open_interest FROM fx_snapshots
WHERE DAYNUM(ts_s) IN (19725, 19731, 19743) AND condition_id IN (SELECT condition_id FROM fx_drift_forecasts WHERE p_market_at_ts > 1e-1)

-- name: latest_quote
SELECT condition_id, ts_s, R(mid) AS mid FROM fx_snapshots QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY ts_s DESC, quote_id DESC) = 1

-- name: market_upsert
WITH old AS (SELECT * FROM fx_universe WHERE first_seen_s < 883612800),
new AS (SELECT *, CASE tier WHEN 'tail' THEN 'liquid' ELSE tier END AS tier2 FROM fx_universe WHERE first_seen_s >= 852076800)
SELECT coalesce(n.condition_id, o.condition_id) AS condition_id, o.event_id, coalesce(n.tier2, o.tier) AS tier, coalesce(n.closed, o.closed) AS closed,
  coalesce(o.first_seen_s, 915220800) AS first_seen_s, coalesce(n.last_synced_s + 86400, o.last_synced_s) AS last_synced_s,
  R(coalesce(n.volume_num, o.volume_num)) AS volume_num
FROM new n FULL OUTER JOIN old o ON o.condition_id = n.condition_id

-- name: resolution_upsert
WITH r AS (SELECT *, CASE WHEN resolved_s % 3 = 0 THEN resolved_s - 3600 END AS venue_s FROM fx_resolutions),
old AS (SELECT * FROM r WHERE resolved_s < 915148800),
new AS (SELECT condition_id, resolved_s + 7200 AS resolved_s, CASE disputed WHEN 1 THEN 1 - payout_yes ELSE payout_yes END AS payout_yes, disputed,
  CASE disputed WHEN 1 THEN resolved_s + 7200 END AS venue_s FROM r WHERE resolved_s >= 852076800)
SELECT coalesce(n.condition_id, o.condition_id) AS condition_id, coalesce(n.resolved_s, o.resolved_s) AS resolved_s,
  coalesce(n.payout_yes, o.payout_yes) AS payout_yes, coalesce(n.disputed, o.disputed) AS disputed, coalesce(n.venue_s, o.venue_s) AS venue_resolved_s
FROM new n FULL OUTER JOIN old o ON o.condition_id = n.condition_id

-- name: close_resolved
SELECT u.condition_id, CASE WHEN r.condition_id IS NULL THEN 0 ELSE 1 END AS closed, CASE WHEN r.condition_id IS NULL THEN 1 ELSE 0 END AS active
FROM fx_universe u LEFT JOIN fx_resolutions r ON r.condition_id = u.condition_id

-- name: forecast_append
WITH x AS (SELECT model_id, ts_s, p_market_at_ts + (p_yes - p_market_at_ts) * 9 AS p, spread_at_ts > 0 AS has_price FROM fx_forecasts)
SELECT model_id, CASE WHEN NOT has_price THEN 'missing_key' WHEN NOT (p > 0 AND p < 1) THEN 'p_out_of_range' END AS reject_reason, count(*) AS n,
  count(DISTINCT ts_s) AS n_inputs FROM x GROUP BY ALL

-- name: ledger_audit
SELECT forecast_id, CASE WHEN p_market_e6 % 17 = 0 THEN 'removed' ELSE 'changed' END AS change FROM fx_micro
WHERE p_market_e6 % 17 = 0 OR p_market_e6 % 13 = 0

-- name: training_observations
SELECT condition_id, obs_day, R(p_market) AS p_market, outcome, category, R(days_to_resolution) AS days_to_resolution FROM fx_training

-- name: volume_sample
SELECT condition_id, R(volume_num) AS volume_num, payout_yes FROM fx_resolved_markets WHERE volume_num >= 50000
ORDER BY fx_resolved_markets.volume_num DESC, condition_id LIMIT 500

-- name: export_latest
SELECT f.condition_id, slug, question, u.category, u.end_s, u.tier, model_id, ts_s, R(p_yes) AS p_yes, R(p_market_at_ts) AS p_market_at_ts,
  R(spread_at_ts) AS spread_at_ts
FROM (SELECT * FROM fx_forecasts QUALIFY rank() OVER (PARTITION BY condition_id, model_id ORDER BY ts_s DESC) = 1) f
JOIN fx_universe u ON u.condition_id = f.condition_id

-- name: export_scored
SELECT forecast_id, r.condition_id, r.venue, r.category, m.tier, r.model_id, ts_s, R(p_yes) AS p_yes, R(p_market_at_ts) AS p_market_at_ts,
  R(spread_at_ts) AS spread_at_ts, resolved_s, payout_yes, r.event_id, r.end_s
FROM fx_all_resolved r JOIN fx_markets m ON m.condition_id = r.condition_id LEFT JOIN fx_versions v ON v.model_id = r.model_id
WHERE disputed = 0 AND (v.registered_s IS NULL OR ts_s >= v.registered_s)

-- name: ledger_increment
SELECT * FROM fx_digests WHERE day < 19723 + 28 AND day > 19723 + 19

-- name: market_increment
WITH first AS (SELECT condition_id, DAYNUM(min(ts_s)) AS day FROM fx_forecasts GROUP BY ALL),
days AS (SELECT DISTINCT day FROM first WHERE day < 10967 AND day NOT BETWEEN 10956 AND 10959)
SELECT f.day, m.condition_id, m.venue, m.category, m.end_s FROM first f JOIN days d ON d.day = f.day JOIN fx_markets m ON m.condition_id = f.condition_id

-- name: reference_subset
WITH used AS (SELECT * FROM fx_markets WHERE condition_id IN (SELECT condition_id FROM fx_forecasts WHERE model_id = 'm7_crossvenue'))
SELECT 'markets' AS part, count(*) AS n, min(condition_id) AS first_id FROM used
UNION ALL SELECT 'events', count(*), min(concat('e', c_custkey)) FROM customer WHERE concat('e', c_custkey) IN (SELECT event_id FROM used)

-- name: restore_merge
WITH m AS (SELECT condition_id, CASE WHEN first_seen_s < 883612800 THEN 'reference' ELSE 'daily' END AS part FROM fx_universe
  WHERE first_seen_s < 883612800 OR first_seen_s BETWEEN 852076800 AND 930000000)
SELECT part, count(*) AS n FROM m GROUP BY part
UNION ALL SELECT CASE WHEN m.condition_id IS NULL THEN 'orphan_resolutions' ELSE 'resolutions' END, count(*)
FROM fx_resolutions r LEFT JOIN m ON m.condition_id = r.condition_id GROUP BY 1

-- name: daily_digest
SELECT t.day, coalesce(row_count, 0) AS row_count, first_id, last_id, coalesce(sha256, sha256('')) AS sha256, cast(86400 * (19723 + 30) AS bigint) AS recorded_s,
  CASE WHEN t.day = 19723 + 29 THEN 1 ELSE 0 END AS prospective
FROM (SELECT unnest(range(19721, 19753)) AS day) t LEFT JOIN fx_digests d ON d.day = t.day WHERE t.day NOT BETWEEN 19723 AND 19725

-- name: verify_records
SELECT day, 1 + CASE WHEN day % 5 = 0 THEN 1 ELSE 0 END AS records, CASE WHEN day % 11 = 0 THEN 0 ELSE 1 END AS verified,
  I(CASE WHEN day % 5 = 0 AND day % 11 <> 0 THEN 1 ELSE 0 END) AS superseded FROM fx_digests
UNION ALL SELECT 19722, 1, 1, 0

-- name: export_digest
SELECT * FROM fx_export_digest

-- name: export_verify
SELECT 1 AS count_ok, 1 AS fields_ok, CASE WHEN EXISTS (SELECT 1 FROM fx_micro WHERE forecast_id = 3) THEN 0 ELSE 1 END AS digest_ok

-- name: increment_verify
SELECT 'forecasts' AS "table", day, row_count AS n, CASE WHEN day < 19742 THEN row_count + CASE WHEN day = 19727 THEN 1 ELSE 0 END END AS mn,
  CASE WHEN day >= 19742 THEN 'not_mirrored' WHEN day = 19727 THEN 'row_count_mismatch' WHEN day = 19730 THEN 'digest_mismatch' ELSE 'ok' END AS state
FROM fx_digests

-- name: manifest_backfill
SELECT *, 'forecasts' AS "table" FROM fx_digests WHERE day BETWEEN 19742 AND 19746
