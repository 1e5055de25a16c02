-- name: fx_markets
SELECT concat('m', o_orderkey) AS condition_id, o_orderkey AS k,
  CASE WHEN o_custkey % 3 <> 0 THEN concat('e', o_custkey) END AS event_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'kalshi' WHEN 3 THEN 'metaculus' ELSE 'polymarket' END AS venue,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL
       WHEN o_orderpriority = '1-URGENT' THEN 'economics' WHEN o_orderpriority = '2-HIGH' THEN 'weather'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'politics' WHEN o_orderpriority = '5-LOW' THEN 'entertainment'
       ELSE 'sports' END AS category,
  CASE WHEN o_totalprice >= 250000 THEN 'liquid' WHEN o_totalprice >= 20000 THEN 'tail' ELSE 'ignored' END AS tier,
  CASE WHEN o_orderkey % 4 IN (1, 2) AND o_custkey % 3 = 1 THEN 1 ELSE 0 END AS neg_risk,
  o_totalprice AS liquidity_num, EPOCH(o_orderdate) AS first_seen_s,
  EPOCH(o_orderdate) + 86400 * (o_orderkey % 200) AS end_s
FROM orders

-- name: fx_resolutions
SELECT concat('m', o_orderkey) AS condition_id,
  EPOCH(o_orderdate) + 86400 * (o_orderkey % 200 + o_orderkey % 15 - 5) AS resolved_s,
  CASE WHEN (o_custkey * 7 + o_orderkey) % 10 < 4 THEN 1e0 ELSE 0e0 END AS payout_yes,
  CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS disputed
FROM orders WHERE o_orderstatus <> 'P'

-- name: fx_forecasts
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
              cast(round(l_extendedprice * 100) AS bigint)) AS forecast_id,
  m.condition_id, m.event_id, m.venue, m.category, m.neg_risk, m.end_s,
  CASE l_linenumber WHEN 1 THEN 'm0_market' WHEN 2 THEN 'm1_debiased' WHEN 3 THEN 'm2_baserate'
       WHEN 4 THEN 'm3_evidence' WHEN 5 THEN 'm4_ensemble' WHEN 6 THEN 'm5_nowcast'
       ELSE 'm7_crossvenue' END AS model_id,
  m.end_s - 86400 * (1 + (l_orderkey * 13 + (l_partkey % 3) * 17) % 120) AS ts_s,
  3e-2 + 94e-2 * (((l_orderkey * 31 + (l_partkey % 3) * 101) % 997) / 996e0) AS p_market_at_ts,
  least(99e-2, greatest(1e-2, 3e-2 + 94e-2 * (((l_orderkey * 31 + (l_partkey % 3) * 101) % 997) / 996e0)
    + (l_discount - 5e-2) * 3e0)) AS p_yes,
  l_tax / 4e0 AS spread_at_ts
FROM lineitem JOIN fx_markets m ON m.k = l_orderkey

-- name: fx_quotes_raw
SELECT event_id AS quote_id, concat('s', user_id) AS condition_id,
  EPOCH(ts) - EPOCH(ts) % 300 AS ts_s, least(98e-2, 2e-2 + 96e-2 * (value / 500e0)) AS mid, props
FROM events

-- name: fx_snapshots
SELECT * FROM fx_quotes_raw QUALIFY row_number() OVER (PARTITION BY condition_id, ts_s ORDER BY quote_id) = 1

-- name: fx_drift_forecasts
SELECT * EXCLUDE (event_type) FROM fx_priced WHERE event_type = 'purchase'

-- name: fx_priced
SELECT event_type, event_id AS forecast_id, concat('s', user_id) AS condition_id, EPOCH(ts) AS ts_s,
  least(98e-2, 2e-2 + 96e-2 * (value / 500e0)) AS p_market_at_ts,
  least(99e-2, greatest(1e-2, least(98e-2, 2e-2 + 96e-2 * (value / 500e0)) + ((event_id % 21) - 10) * 1e-2)) AS p_yes
FROM events

-- name: fx_all_resolved
SELECT f.*, r.payout_yes, r.resolved_s, r.disputed, greatest(r.resolved_s, f.end_s + 604800) AS entry_s,
  coalesce(nullif(f.event_id, ''), f.condition_id) AS cluster_id,
  pow(f.p_market_at_ts - r.payout_yes, 2) - pow(f.p_yes - r.payout_yes, 2) AS diff
FROM fx_forecasts f JOIN fx_resolutions r ON r.condition_id = f.condition_id
WHERE f.ts_s <= 978307200 AND r.resolved_s <= 978307200

-- name: fx_scored
SELECT * FROM fx_all_resolved WHERE disputed = 0 AND end_s + 604800 <= 978307200

-- name: fx_versions
SELECT model_id, min(ts_s) + (max(ts_s) - min(ts_s)) // 2 AS registered_s FROM fx_forecasts
WHERE model_id IN ('m3_evidence', 'm7_crossvenue') GROUP BY model_id

-- name: fx_fees
SELECT cast(8035 + 120 * n_nationkey AS bigint) AS effective_day,
  CASE n_nationkey % 4 WHEN 0 THEN 'kalshi' WHEN 3 THEN 'metaculus' ELSE 'polymarket' END AS venue,
  CASE n_nationkey % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'weather' ELSE 'politics' END AS category,
  n_nationkey / 400e0 AS taker_rate FROM nation

-- name: fx_control
SELECT venue, condition_id, rank FROM (
  SELECT venue, condition_id,
    row_number() OVER (PARTITION BY venue ORDER BY sha256(concat_ws(':', '42', venue, condition_id)), condition_id) AS rank
  FROM fx_markets WHERE category = 'sports') WHERE rank <= 200

-- name: fx_flagged
SELECT r.*, EXISTS (SELECT 1 FROM fx_control c WHERE c.condition_id = r.condition_id) AS is_control,
  end_s + 604800 <= 978307200 AS scoreable,
  CASE WHEN end_s - ts_s <= 0 THEN NULL WHEN end_s - ts_s < 604800 THEN 'lt7d' WHEN end_s - ts_s < 2592000 THEN '7to30d'
       WHEN end_s - ts_s < 7776000 THEN '30to90d' ELSE 'gt90d' END AS stated_bucket,
  CASE WHEN resolved_s - ts_s <= 0 THEN NULL WHEN resolved_s - ts_s < 604800 THEN 'lt7d'
       WHEN resolved_s - ts_s < 2592000 THEN '7to30d' WHEN resolved_s - ts_s < 7776000 THEN '30to90d'
       ELSE 'gt90d' END AS realized_bucket,
  row_number() OVER (PARTITION BY condition_id, model_id, DAYNUM(ts_s), (disputed = 0 AND end_s + 604800 <= 978307200)
                     ORDER BY ts_s, forecast_id) AS day_rank
FROM fx_all_resolved r

-- name: fx_variants
SELECT f.*, v.variant FROM fx_flagged f JOIN (VALUES ('primary'), ('disputed_inclusive'), ('dedup_daily'),
  ('pre_end_date'), ('since'), ('pool_since'), ('negrisk'), ('non_negrisk'), ('uncensored')) v(variant) ON
  CASE variant
    WHEN 'primary' THEN scoreable AND disputed = 0
    WHEN 'disputed_inclusive' THEN scoreable
    WHEN 'dedup_daily' THEN scoreable AND disputed = 0 AND day_rank = 1
    WHEN 'pre_end_date' THEN scoreable AND disputed = 0 AND ts_s < end_s
    WHEN 'since' THEN scoreable AND disputed = 0 AND ts_s >= 883612800
    WHEN 'pool_since' THEN scoreable AND disputed = 0 AND model_id = 'm7_crossvenue' AND ts_s >= 915148800
    WHEN 'negrisk' THEN scoreable AND disputed = 0 AND model_id = 'm1_debiased' AND neg_risk = 1
    WHEN 'non_negrisk' THEN scoreable AND disputed = 0 AND model_id = 'm1_debiased' AND neg_risk = 0
    ELSE disputed = 0 END

-- name: fx_legs
SELECT event_id, condition_id, first_seen_s,
  cast(floor(liquidity_num) AS double) AS order_value
FROM fx_markets WHERE venue = 'polymarket' AND neg_risk = 1 AND event_id IS NOT NULL

-- name: fx_leg_rows
SELECT concat_ws('-', condition_id, pass, m) AS forecast_id,
  CASE m WHEN 1 THEN 'm1_debiased' ELSE 'm4_ensemble' END AS model_id, event_id, condition_id, venue,
  978307200 - 86400 * (300 + 700 * pass) AS ts_s,
  2e-2 + 9e-1 * (((k * 31 + pass * 101) % 997) / 996e0) AS p_market_at_ts,
  least(99e-2, (2e-2 + 9e-1 * (((k * 31 + pass * 101) % 997) / 996e0)) * (8e-1 + 1e-1 * ((k + m) % 5))) AS p_yes,
  CASE WHEN (k * 7 + cast(substr(event_id, 2) AS bigint)) % 10 = 0 THEN 1e0 ELSE 0e0 END AS payout_yes
FROM fx_markets, (VALUES (0), (1), (2)) p(pass), (VALUES (1), (4)) q(m)
WHERE venue = 'polymarket' AND neg_risk = 1 AND event_id IS NOT NULL
  AND first_seen_s <= 978307200 - 86400 * (300 + 700 * pass) AND (k + 3 * pass) % 17 <> 0

-- name: fx_bucket_passes
SELECT r.model_id, r.event_id, r.ts_s, r.condition_id, l.order_value, r.p_yes, r.p_market_at_ts, r.payout_yes
FROM fx_leg_rows r JOIN fx_legs l ON l.condition_id = r.condition_id
JOIN (SELECT model_id, event_id, max(ts_s) AS ts_s FROM (
        SELECT p.model_id, p.event_id, p.ts_s FROM (
          SELECT model_id, event_id, ts_s, count(DISTINCT condition_id) AS held FROM fx_leg_rows GROUP BY ALL) p
        JOIN (SELECT x.event_id, x.ts_s, count(*) AS required
              FROM (SELECT DISTINCT event_id, ts_s FROM fx_leg_rows) x
              JOIN fx_legs l ON l.event_id = x.event_id AND l.first_seen_s <= x.ts_s GROUP BY ALL) q
          ON q.event_id = p.event_id AND q.ts_s = p.ts_s AND q.required = p.held) GROUP BY ALL) c
  ON c.model_id = r.model_id AND c.event_id = r.event_id AND c.ts_s = r.ts_s

-- name: fx_bucket_verdicts
SELECT model_id, event_id, ts_s, count(*) AS k, I(sum(payout_yes)) AS winners, sum(p_yes) AS sum_model,
  sum(p_market_at_ts) AS sum_market,
  CASE WHEN count(DISTINCT order_value) < count(*) THEN 'unordered' WHEN sum(payout_yes) <> 1 THEN 'not_one_winner'
       ELSE 'ok' END AS verdict
FROM fx_bucket_passes GROUP BY ALL

-- name: fx_rps
SELECT model_id, event_id, max(k) AS k, sum(pow(cdf_model - step, 2)) / (max(k) - 1) AS rps_model,
  sum(pow(cdf_market - step, 2)) / (max(k) - 1) AS rps_market
FROM (SELECT p.model_id, p.event_id, v.k,
        sum(p.p_yes / v.sum_model) OVER w AS cdf_model, sum(p.p_market_at_ts / v.sum_market) OVER w AS cdf_market,
        sum(p.payout_yes) OVER w AS step
      FROM fx_bucket_passes p JOIN fx_bucket_verdicts v ON v.model_id = p.model_id AND v.event_id = p.event_id
      WHERE v.verdict = 'ok' AND v.k > 1
      WINDOW w AS (PARTITION BY p.model_id, p.event_id ORDER BY p.order_value))
GROUP BY model_id, event_id

-- name: fx_rated
SELECT s.*, coalesce((SELECT max_by(taker_rate, (CASE WHEN f.category = s.category THEN 100000 ELSE 0 END) + f.effective_day)
    FROM fx_fees f WHERE f.venue = s.venue AND f.effective_day <= DAYNUM(s.ts_s)
      AND (f.category = s.category OR f.category = 'default')), 0e0) AS taker_rate
FROM fx_scored s

-- name: fx_gaps
SELECT 1704067200 + 900 * i AS gap_start_s, 1704067200 + 900 * (i + 1) AS gap_end_s FROM range(2880) t(i)
WHERE NOT EXISTS (SELECT 1 FROM fx_snapshots s WHERE s.ts_s >= 1704067200 + 900 * i AND s.ts_s < 1704067200 + 900 * (i + 1))

-- name: fx_asof24
SELECT f.*, f.ts_s + 86400 AS target_s, n.ts_s AS quote_s, n.mid FROM fx_drift_forecasts f
JOIN fx_snapshots n ON n.condition_id = f.condition_id AND n.ts_s BETWEEN f.ts_s + 86400 - 10800 AND f.ts_s + 86400 + 10800
QUALIFY row_number() OVER (PARTITION BY f.forecast_id ORDER BY abs(n.ts_s - f.ts_s - 86400), n.ts_s) = 1

-- name: fx_eval_runs
SELECT o_orderkey AS run_id, EPOCH(o_orderdate) AS ts_s, concat('m', o_orderkey % 7) AS model_id,
  CASE o_custkey % 3 WHEN 0 THEN 'all_time' WHEN 1 THEN 'trailing_90d' ELSE 'confirmatory' END AS window_label,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 < 3 THEN 'polymarket' ELSE 'kalshi' END AS venue,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 < 6 THEN 'weather' ELSE 'ALL' END AS category,
  o_custkey % 900 AS n_event_clusters, (o_totalprice % 1000) / 1e4 - 5e-2 AS skill,
  1e-3 + (o_orderkey % 13) / 1e3 AS mde, CASE WHEN o_orderkey % 4 <> 0 THEN (o_custkey % 40) / 1e2 END AS rps,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 50) / 1e3 - 2e-2 END AS net_growth
FROM orders

-- name: fx_eval_latest
SELECT e.* FROM fx_eval_runs e WHERE NOT (coalesce(venue, 'polymarket') = 'kalshi' AND ts_s < 883612800)
QUALIFY rank() OVER (PARTITION BY model_id, window_label, venue, category ORDER BY ts_s DESC) = 1

-- name: fx_universe
SELECT m.*, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS active,
  concat_ws('-', concat('SER', k % 97), k // 97 % 31, k) AS venue_native_id, concat('q-', k) AS slug,
  CASE WHEN k % 40 = 0 THEN concat('Will Bitcoin trade above $', k, '?')
       WHEN k % 40 = 1 THEN concat('Market cap of firm ', k, ' above $2,000?')
       ELSE concat('Will the count exceed ', k, '?') END AS question,
  first_seen_s AS start_s, CASE WHEN k % 31 = 0 THEN 3 ELSE 2 END AS n_outcomes,
  CASE WHEN k % 29 = 0 THEN 0 ELSE 1 END AS order_book, liquidity_num * (1 + k % 20) AS volume_num,
  liquidity_num % 5000 AS volume_24h_num, cast(k % 300 AS double) AS open_interest,
  CASE WHEN k % 7 <> 0 THEN 915220800 - 3600 * (k % 500) END AS checked_s, 915220800 - 3600 * (k % 48) AS last_synced_s
FROM fx_markets m JOIN orders ON o_orderkey = k

-- name: fx_mquotes
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) AS bigint)) AS quote_id,
  concat('m', l_orderkey) AS condition_id, 915220800 - 60 * (l_partkey % 200) AS ts_s,
  CASE WHEN l_suppkey % 23 <> 0 THEN 1e-2 + 98e-2 * (((l_orderkey * 31 + l_partkey * 7) % 997) / 996e0) END AS mid,
  l_tax / 2e0 AS spread, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity * 10e0 END AS bid_depth_usd,
  CASE WHEN l_partkey % 5 <> 0 THEN l_quantity * (l_partkey % 30) END AS ask_depth_usd
FROM lineitem

-- name: fx_latest
SELECT *, CASE WHEN bid_depth_usd IS NOT NULL OR ask_depth_usd IS NOT NULL
  THEN coalesce(bid_depth_usd, 0) + coalesce(ask_depth_usd, 0) END AS depth_usd
FROM fx_mquotes QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY ts_s DESC, quote_id DESC) = 1

-- name: fx_reasons
SELECT u.*, q.mid, list_filter([
    CASE WHEN n_outcomes <> 2 THEN 'non_binary' END,
    CASE WHEN k % 40 = 0 AND (end_s - start_s <= 86400 OR end_s - 915220800 <= 86400) THEN 'sub_24h' END,
    CASE WHEN k % 40 IN (0, 1) THEN 'price_target' END,
    CASE WHEN tier IN ('liquid', 'tail') AND NOT (mid > 5e-2 AND mid < 95e-2) THEN 'tail_price' END], lambda x : x IS NOT NULL) AS reasons
FROM fx_universe u LEFT JOIN fx_latest q ON q.condition_id = u.condition_id

-- name: fx_sample
SELECT condition_id FROM fx_universe WHERE category = 'sports' AND tier <> 'ignored' AND active = 1
QUALIFY row_number() OVER (PARTITION BY venue ORDER BY sha256(concat_ws(':', '42', venue, condition_id)), condition_id) <= 100

-- name: fx_outside
SELECT condition_id FROM fx_universe WHERE category = 'sports' AND condition_id NOT IN (SELECT condition_id FROM fx_sample)

-- name: fx_screened
SELECT u.*, q.mid, q.spread, q.ts_s AS quote_s, q.depth_usd, greatest(0e0, (end_s - 915220800) / 86400e0) AS days_to_resolution,
  CASE WHEN end_s <= 915220800 THEN 'ended' WHEN mid IS NULL THEN 'unpriced'
       WHEN 915220800 - q.ts_s > 60 * CASE tier WHEN 'liquid' THEN 15 ELSE 90 END THEN 'stale'
       WHEN NOT (mid > 5e-2 AND mid < 95e-2) THEN 'out_of_bounds' END AS reason
FROM fx_universe u LEFT JOIN fx_latest q ON q.condition_id = u.condition_id
WHERE tier <> 'ignored' AND active = 1 AND closed = 0 AND u.condition_id NOT IN (SELECT condition_id FROM fx_outside)

-- name: fx_tags
SELECT concat('p', p_partkey) AS condition_id,
  unnest(list_concat(string_split(p_name, ' '), [lower(p_type), lower(p_brand)])) AS raw_tag FROM part

-- name: fx_taxonomy
SELECT raw_tag, HASH(raw_tag) % 5 AS priority, concat('c', HASH(raw_tag) % 5) AS category
FROM (SELECT DISTINCT raw_tag FROM fx_tags) WHERE HASH(raw_tag) % 3 = 0

-- name: fx_ranked
SELECT u.condition_id, category, liquidity_num, row_number() OVER (ORDER BY liquidity_num DESC, u.condition_id) AS rank
FROM fx_universe u JOIN fx_latest q ON q.condition_id = u.condition_id
WHERE tier = 'liquid' AND active = 1 AND category IN ('economics', 'weather', 'politics', 'geopolitics', 'entertainment')
  AND mid > 5e-2 AND mid < 95e-2

-- name: fx_micro
SELECT forecast_id, condition_id, ts_s, cast(round(p_yes * 1e6) AS bigint) AS p_yes_e6, cast(round(p_market_at_ts * 1e6) AS bigint) AS p_market_e6
FROM fx_priced

-- name: fx_micro_text
SELECT *, DAYNUM(ts_s) AS day, sha256(cast(forecast_id AS varchar)) AS h,
  sha256(concat('{"condition_id":"', condition_id, '","forecast_id":', forecast_id, ',"p_market_e6":', p_market_e6,
    ',"p_yes_e6":', p_yes_e6, ',"ts_s":', ts_s, '}')) AS d FROM fx_micro

-- name: fx_digests
SELECT day, I(sum(n)) AS row_count, min(first_id) AS first_id, max(last_id) AS last_id, sha256(string_agg(d, chr(10) ORDER BY node)) AS sha256
FROM (SELECT day, substr(leaf, 1, 3) AS node, sum(n) AS n, min(first_id) AS first_id, max(last_id) AS last_id,
        sha256(string_agg(d, chr(10) ORDER BY leaf)) AS d
      FROM (SELECT day, substr(h, 1, 6) AS leaf, count(*) AS n, min(forecast_id) AS first_id, max(forecast_id) AS last_id,
              sha256(string_agg(d, chr(10) ORDER BY h)) AS d FROM fx_micro_text GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1

-- name: fx_export_digest
SELECT I(sum(n)) AS row_count, 'condition_id,forecast_id,p_market_e6,p_yes_e6,ts_s' AS fields, sha256(string_agg(d, chr(10) ORDER BY node)) AS sha256
FROM (SELECT substr(leaf, 1, 3) AS node, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY leaf)) AS d
      FROM (SELECT substr(h, 1, 6) AS leaf, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY h)) AS d FROM fx_micro_text GROUP BY 1) GROUP BY 1)

-- name: fx_trades
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) AS bigint)) AS trade_id,
  concat('m', l_orderkey) AS condition_id, ((l_orderkey * 31 + (l_partkey % 3) * 101) % 997) / 996e0 AS price,
  EPOCH(l_shipdate) + 60 * (l_partkey % 1440) + 946684800 AS obs_s FROM lineitem

-- name: fx_resolved_markets
SELECT u.*, r.payout_yes, coalesce(category, 'unknown') AS cat FROM fx_universe u JOIN fx_resolutions r ON r.condition_id = u.condition_id
WHERE n_outcomes = 2 AND r.disputed = 0

-- name: fx_training
SELECT t.condition_id, DAYNUM(obs_s) AS obs_day, arg_max(price, (obs_s, trade_id)) AS p_market, max(payout_yes) AS outcome, max(cat) AS category,
  arg_max((end_s + 946684800 - obs_s) / 86400e0, (obs_s, trade_id)) AS days_to_resolution
FROM fx_trades t JOIN fx_resolved_markets m ON m.condition_id = t.condition_id WHERE price > 0 AND price < 1 AND obs_s < end_s + 946684800
GROUP BY 1, 2

-- name: fx_states
SELECT condition_id, venue, category, event_id, mid AS p_market, days_to_resolution,
  CASE WHEN days_to_resolution <= 0 THEN NULL WHEN days_to_resolution < 7 THEN 'lt7d' WHEN days_to_resolution < 30 THEN '7to30d'
       WHEN days_to_resolution < 90 THEN '30to90d' ELSE 'gt90d' END AS bucket
FROM fx_screened WHERE reason IS NULL

-- name: fx_curves
SELECT CASE r_regionkey WHEN 0 THEN 'lt7d' WHEN 1 THEN '7to30d' WHEN 2 THEN '30to90d' END AS bucket, (r_regionkey - 2) / 20e0 AS alpha,
  9e-1 + r_regionkey / 20e0 AS beta FROM region WHERE r_regionkey <= 2

-- name: fx_offsets
SELECT CASE b WHEN 0 THEN 'lt7d' WHEN 1 THEN '7to30d' WHEN 2 THEN '30to90d' ELSE 'gt90d' END AS bucket,
  CASE v WHEN 0 THEN 'kalshi' WHEN 1 THEN 'metaculus' ELSE 'polymarket' END AS venue, k / 50e0 AS alpha_offset, k / 100e0 - 1e-1 AS beta_offset
FROM (SELECT n_nationkey % 4 AS b, n_nationkey // 4 % 3 AS v, min(n_nationkey) AS k FROM nation GROUP BY 1, 2) WHERE (b + v) % 4 <> 3

-- name: fx_base_rates
SELECT category, avg(payout_yes) AS base_rate FROM fx_resolutions r JOIN fx_markets m ON m.condition_id = r.condition_id
WHERE category IS NOT NULL AND category <> 'sports' GROUP BY category

-- name: fx_weights
SELECT category, model_id, HASH(concat(category, '|', model_id)) % 5 / 10e0 AS weight FROM (SELECT DISTINCT category, model_id FROM fx_forecasts)
WHERE category IN ('economics', 'weather', 'politics')

-- name: fx_exponents
SELECT category, 1 + HASH(category) % 7 / 4e0 AS a, HASH(concat('r', category)) % 10 / 10e0 AS rho_bar FROM (SELECT DISTINCT category FROM fx_forecasts)
WHERE category IN ('economics', 'sports')

-- name: fx_members
WITH latest AS (SELECT condition_id, category, DAYNUM(ts_s) AS day, model_id, p_yes FROM fx_forecasts
  WHERE model_id IN ('m0_market', 'm1_debiased', 'm2_baserate', 'm3_evidence', 'm5_nowcast', 'm6_consistency', 'm7_crossvenue')
  QUALIFY row_number() OVER (PARTITION BY condition_id, DAYNUM(ts_s), model_id ORDER BY ts_s DESC, forecast_id DESC) = 1),
raw AS (SELECT l.*, CASE WHEN EXISTS (SELECT 1 FROM fx_weights w WHERE w.category = l.category)
    THEN coalesce((SELECT weight FROM fx_weights w WHERE w.category = l.category AND w.model_id = l.model_id), 0e0) ELSE 1e0 END AS w FROM latest l),
tot AS (SELECT condition_id, day, sum(w) AS sw, count(*) AS n FROM raw GROUP BY ALL)
SELECT raw.*, tot.n, CASE WHEN sw > 0 THEN w / sw ELSE 1e0 / tot.n END AS share, LOGIT(p_yes) AS lg
FROM raw JOIN tot ON tot.condition_id = raw.condition_id AND tot.day = raw.day WHERE tot.n >= 2

-- name: fx_pooled
SELECT condition_id, day, category, max(n) AS n, sum(share * lg) AS raw_logit FROM fx_members GROUP BY ALL

-- name: fx_obs
SELECT forecast_id AS obs_id, condition_id, category, venue, cluster_id, entry_s, p_market_at_ts AS p_market, payout_yes AS outcome,
  (end_s - ts_s) / 86400e0 AS days, CASE WHEN end_s - ts_s < 604800 THEN 'lt7d' WHEN end_s - ts_s < 2592000 THEN '7to30d'
    WHEN end_s - ts_s < 7776000 THEN '30to90d' ELSE 'gt90d' END AS bucket
FROM fx_scored WHERE model_id = 'm0_market' AND end_s > ts_s

-- name: fx_points
SELECT condition_id, ts_s, coalesce(category, 'unknown') AS category, model_id, LOGIT(arg_max(p_yes, forecast_id)) AS lg
FROM fx_forecasts WHERE model_id IN ('m0_market', 'm1_debiased', 'm2_baserate', 'm3_evidence', 'm5_nowcast', 'm7_crossvenue') GROUP BY ALL

-- name: fx_pair_rho
SELECT x.category, x.model_id AS a, y.model_id AS b, count(*) AS n, corr(x.lg, y.lg) AS rho FROM fx_points x
JOIN fx_points y ON y.condition_id = x.condition_id AND y.ts_s = x.ts_s AND x.model_id < y.model_id
GROUP BY ALL HAVING count(*) >= 30 AND var_pop(x.lg) > 0 AND var_pop(y.lg) > 0

-- name: fx_surprises
SELECT concat('S', c_nationkey) AS series, c_custkey AS period, c_acctbal / 1000e0 AS nowcast,
  c_acctbal / 1000e0 + (c_custkey * 37 % 101 - 50) / 100e0 AS actual FROM customer WHERE c_custkey % 6 <> 0

-- name: fx_kelly
SELECT *, CASE WHEN p_yes > p_market_at_ts THEN 'YES' ELSE 'NO' END AS side,
  CASE WHEN p_yes > p_market_at_ts THEN p_market_at_ts ELSE 1 - p_market_at_ts END AS price,
  CASE WHEN p_yes > p_market_at_ts THEN p_yes ELSE 1 - p_yes END AS p_win FROM fx_scored

-- name: fx_delta
SELECT *, CASE WHEN f <= 0 THEN 0e0 WHEN (payout_yes = 1) = (side = 'YES') THEN ln(1 - f + f / price) ELSE ln(1 - f) END AS delta,
  coalesce(category, 'unknown') AS cat
FROM (SELECT *, CASE WHEN (p_win - price) / (1 - price) > 0 THEN least((p_win - price) / (1 - price) * 2e-1, 5e-2) ELSE 0e0 END AS f FROM fx_kelly)

-- name: fx_wealth
SELECT model_id, cat AS category, forecast_id, f AS kelly, sum(delta) OVER w AS cum, row_number() OVER w AS n FROM fx_delta
WINDOW w AS (PARTITION BY model_id, cat ORDER BY entry_s, ts_s, forecast_id ROWS UNBOUNDED PRECEDING)

-- name: fx_experts
SELECT model_id, category, arg_max(cum, n) AS cum, max(n) AS n, arg_max(cum, n) / max(n) AS avg_lw FROM fx_wealth GROUP BY ALL

-- name: fx_replay_members
WITH last AS (SELECT condition_id, max(ts_s) AS pool_s, max(payout_yes) AS outcome, max(coalesce(category, 'unknown')) AS category,
    max(cluster_id) AS cluster_id, max(entry_s) AS entry_s FROM fx_scored WHERE model_id = 'm4_ensemble' GROUP BY ALL),
m AS (SELECT f.condition_id, f.model_id, arg_max(f.p_yes, (f.ts_s, f.forecast_id)) AS p_yes FROM fx_forecasts f JOIN last l ON l.condition_id = f.condition_id
  WHERE f.ts_s <= l.pool_s AND f.model_id <> 'm4_ensemble' GROUP BY ALL)
SELECT m.*, l.pool_s, l.outcome, l.category, l.cluster_id, l.entry_s, count(*) OVER (PARTITION BY m.condition_id) AS n_members
FROM m JOIN last l ON l.condition_id = m.condition_id QUALIFY n_members >= 2

-- name: fx_replayed
WITH curves AS (SELECT 'old' AS version, * FROM fx_curves UNION ALL SELECT 'new', bucket, -4e-1, 1e-1 FROM fx_curves),
wts AS (SELECT 'old' AS version, * FROM fx_weights UNION ALL SELECT 'new', category, model_id, 6e-1 - weight FROM fx_weights WHERE category <> 'politics'),
raw AS (SELECT v.version, m.*, CASE WHEN EXISTS (SELECT 1 FROM wts w WHERE w.version = v.version AND w.category = m.category)
    THEN coalesce((SELECT weight FROM wts w WHERE w.version = v.version AND w.category = m.category AND w.model_id = m.model_id), 0e0) ELSE 1e0 END AS w
  FROM fx_replay_members m, (VALUES ('old'), ('new')) v(version)),
pools AS (SELECT version, condition_id, max(outcome) AS outcome, max(cluster_id) AS cluster_id, max(entry_s) AS entry_s,
    SIGMOID(CASE WHEN sum(w) > 0 THEN sum(w * LOGIT(p_yes)) / sum(w) ELSE avg(LOGIT(p_yes)) END) AS p FROM raw GROUP BY version, condition_id)
SELECT 'm1_curves' AS model_key, obs_id AS row_id, v.version, coalesce(SIGMOID(alpha + beta * LOGIT(p_market)), p_market) AS p, outcome, cluster_id, entry_s
FROM fx_obs o CROSS JOIN (VALUES ('old'), ('new')) v(version) LEFT JOIN curves c ON c.version = v.version AND c.bucket = o.bucket
UNION ALL SELECT 'm4_weights', condition_id, version, p, outcome, cluster_id, entry_s FROM pools

-- name: fx_gate_rows
SELECT model_key, row_id, max(cluster_id) AS cluster_id, max(entry_s) AS entry_s,
  max(pow(p - outcome, 2)) FILTER (version = 'old') - max(pow(p - outcome, 2)) FILTER (version = 'new') AS diff
FROM fx_replayed GROUP BY ALL

-- name: fx_trades_book
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) AS bigint)) AS trade_id,
  concat('m', l_orderkey) AS condition_id, EPOCH(l_shipdate) AS opened_s, CASE WHEN l_suppkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS token_side,
  1e-1 + 8e-1 * ((l_orderkey * 31 + l_partkey * 7) % 997) / 996e0 AS entry_price, l_quantity * 10 AS stake,
  CASE WHEN l_tax > 0 THEN l_quantity * l_tax END AS fee FROM lineitem

-- name: fx_settled
SELECT t.*, r.resolved_s AS exit_s, stake / entry_price * CASE WHEN (payout_yes = 1) = (token_side = 'YES') THEN 1 ELSE 0 END - stake - coalesce(fee, 0) AS pnl
FROM fx_trades_book t JOIN fx_resolutions r ON r.condition_id = t.condition_id
