-- name: gap_windows
SELECT gap_start_s, gap_end_s FROM fx_gaps

-- name: gap_overlap
SELECT forecast_id, CASE WHEN EXISTS (SELECT 1 FROM fx_gaps g WHERE ts_s < g.gap_end_s AND g.gap_start_s < ts_s + 3600) THEN 1 ELSE 0 END AS in_gap FROM fx_drift_forecasts

-- name: freshness
WITH t AS (SELECT condition_id, tier, venue, CASE tier WHEN 'liquid' THEN 300 WHEN 'tail' THEN 3600 END AS step FROM fx_universe WHERE active = 1 AND closed = 0),
s AS (SELECT t.*, q.ts_s FROM t JOIN fx_mquotes q ON q.condition_id = t.condition_id WHERE q.ts_s BETWEEN 915220800 - 604800 AND 915220800),
g AS (SELECT tier, 86400 // max(step) - count(DISTINCT (ts_s - 915220800 + 86400) // step) FILTER (ts_s >= 915220800 - 86400 AND ts_s < 915220800) AS g1,
  604800 // max(step) - count(DISTINCT (ts_s - 915220800 + 604800) // step) FILTER (ts_s < 915220800) AS g7 FROM s WHERE step IS NOT NULL GROUP BY tier)
SELECT c.tier, c.venue, tracked, newest_s, R((915220800 - newest_s) / 60e0) AS age_min, g1 AS gaps_24h, g7 AS gaps_7d
FROM (SELECT tier, venue, count(*) AS tracked FROM t GROUP BY ALL) c
LEFT JOIN (SELECT tier, venue, max(ts_s) AS newest_s FROM s GROUP BY ALL) n ON n.tier = c.tier AND n.venue = c.venue LEFT JOIN g ON g.tier = c.tier

-- name: coverage_drop
WITH d AS (SELECT model_id, venue, DAYNUM(ts_s) AS day, count(*) AS n FROM fx_forecasts WHERE DAYNUM(ts_s) BETWEEN 10586 AND 10600 GROUP BY ALL),
s AS (SELECT model_id, venue, median(n) FILTER (day < 10600) AS baseline, count(*) FILTER (day < 10600) AS n_prior, coalesce(max(n) FILTER (day = 10600), 0) AS n FROM d GROUP BY ALL)
SELECT model_id, venue, R(baseline) AS baseline, n_prior, n, R(n / baseline) AS ratio, I(10600) AS day FROM s WHERE n_prior >= 3 AND s.baseline >= 1 AND n < 5e-1 * s.baseline

-- name: watch_backlog
SELECT venue, count(*) FILTER (waiting) AS backlog, count(*) FILTER (waiting AND checked_s IS NULL) AS never_checked,
  R((915220800 - min(checked_s) FILTER (waiting)) / 3600e0) AS oldest_check_age_h, count(*) FILTER (active = 1 AND end_s < 915220800) AS active_past_end
FROM (SELECT *, condition_id NOT IN (SELECT condition_id FROM fx_resolutions) AND (closed = 1 OR end_s < 915220800) AS waiting FROM fx_universe) GROUP BY venue

-- name: counts_by_tier
SELECT tier, count(*) AS n FROM fx_universe GROUP BY tier

-- name: venue_counts
SELECT venue, count(*) AS markets, count(r.condition_id) AS resolutions, count(*) FILTER (closed = 1 AND r.condition_id IS NULL) AS closed_unresolved
FROM fx_universe u LEFT JOIN fx_resolutions r ON r.condition_id = u.condition_id GROUP BY venue

-- name: spend_by_day
WITH p AS (SELECT DAYNUM(EPOCH(l_shipdate)) AS day, concat('purpose_', l_returnflag) AS purpose, sum(l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT day, purpose, R(c) AS cost_usd, R(sum(c) OVER (PARTITION BY day)) AS day_usd, CASE WHEN round(sum(c) OVER (PARTITION BY day), 6) >= 15e-1 THEN 1 ELSE 0 END AS over_cap FROM p

-- name: exclusions_by_day
WITH log AS (SELECT venue, condition_id, reason, DAYNUM(ts_s) AS day, min(ts_s) AS ts_s FROM (
  SELECT venue, condition_id, unnest(reasons) AS reason, EPOCH(l_shipdate) + 3600 * l_linenumber AS ts_s FROM fx_reasons JOIN lineitem ON l_orderkey = k) GROUP BY ALL)
SELECT day, reason, count(*) AS n FROM log WHERE ts_s >= 883612800 GROUP BY ALL

-- name: inclusions_by_day
SELECT DAYNUM(first_seen_s) AS day, tier, count(*) AS n FROM fx_universe WHERE first_seen_s >= 883612800 AND tier <> 'ignored' GROUP BY ALL

-- name: skill_table
SELECT run_id, ts_s, model_id, window_label, venue, category, n_event_clusters, R(skill) AS skill, R(mde) AS mde, R(rps) AS rps, R(net_growth) AS net_growth,
  CASE WHEN n_event_clusters < 200 THEN 'INSUFFICIENT DATA' WHEN n_event_clusters < 500 THEN 'PRELIMINARY' ELSE 'STANDARD' END AS label FROM fx_eval_latest

-- name: top_disagreements
SELECT forecast_id, condition_id, R(p_yes) AS p_yes, R(p_market_at_ts) AS p_market_at_ts, R(p_yes - p_market_at_ts) AS disagreement FROM (
  SELECT * FROM fx_forecasts WHERE model_id = 'm4_ensemble' QUALIFY rank() OVER (PARTITION BY condition_id ORDER BY ts_s DESC) = 1) l
ORDER BY abs(l.p_yes - l.p_market_at_ts) DESC, forecast_id LIMIT 20

-- name: extremes
WITH r AS (SELECT *, row_number() OVER (ORDER BY diff, forecast_id) AS pos, count(*) OVER () AS total FROM fx_scored WHERE ts_s >= 852076800 AND model_id <> 'm0_market'),
k AS (SELECT *, greatest(1, floor(total * 1e-1)) AS k FROM r),
b AS (SELECT 'miss' AS kind, * FROM k WHERE pos <= k UNION ALL SELECT 'win', * FROM k WHERE pos > total - k)
SELECT kind, forecast_id, condition_id, model_id, R(diff) AS diff FROM b WHERE NOT (model_id = 'm2_baserate' AND kind = 'miss')
