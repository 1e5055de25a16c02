-- name: scored_rows
SELECT forecast_id, model_id, cluster_id, entry_s, payout_yes, R(p_yes) AS p_yes, R(p_market_at_ts) AS p_market_at_ts
FROM fx_scored

-- name: forward_only
SELECT f.model_id, count(*) AS n, min(ts_s) AS first_ts_s FROM fx_forecasts f
LEFT JOIN fx_versions v ON v.model_id = f.model_id WHERE v.registered_s IS NULL OR f.ts_s >= v.registered_s
GROUP BY f.model_id

-- name: exclude_windows
SELECT venue, model_id, count(*) AS n, I(sum(ts_s)) AS sum_ts_s FROM fx_forecasts
WHERE NOT (venue = 'kalshi' AND (DAYNUM(ts_s) BETWEEN 9400 AND 9420 OR DAYNUM(ts_s) = 9700
           OR DAYNUM(ts_s) BETWEEN 10100 AND 10160)) GROUP BY venue, model_id

-- name: horizon_bucket
SELECT model_id, stated_bucket, realized_bucket, count(*) AS n FROM fx_flagged
WHERE scoreable AND disputed = 0 GROUP BY ALL

-- name: window_members
SELECT model_id, window_label, count(*) AS n, R(avg(diff)) AS skill FROM fx_scored
JOIN (VALUES ('all_time', 0), ('trailing_90d', 978307200 - 7776000), ('confirmatory', 852076800)) w(window_label, lo)
  ON ts_s >= lo AND ts_s <= 978307200 GROUP BY ALL

-- name: robustness_variants
SELECT variant, model_id, count(*) AS n, R(avg(diff)) AS skill FROM fx_variants GROUP BY ALL

-- name: eval_matrix
WITH placed AS (
  SELECT v.*, w.window_label FROM fx_variants v
  JOIN (VALUES ('all_time', 0), ('trailing_90d', 978307200 - 7776000), ('confirmatory', 852076800),
               ('null_control', 0)) w(window_label, lo)
    ON v.ts_s >= w.lo AND (w.window_label = 'null_control') = v.is_control),
cells AS (
  SELECT model_id, venue, 'ALL' AS category, window_label, 'all' AS horizon, variant, cluster_id, p_yes, p_market_at_ts, payout_yes, diff FROM placed
  UNION ALL
  SELECT model_id, venue, category, window_label, 'all', variant, cluster_id, p_yes, p_market_at_ts, payout_yes, diff FROM placed
  WHERE category IS NOT NULL AND NOT is_control
  UNION ALL
  SELECT model_id, venue, 'ALL', window_label, 'hs_' || stated_bucket, variant, cluster_id, p_yes, p_market_at_ts, payout_yes, diff FROM placed
  WHERE stated_bucket IS NOT NULL AND NOT is_control
  UNION ALL
  SELECT model_id, venue, 'ALL', window_label, 'hr_' || realized_bucket, variant, cluster_id, p_yes, p_market_at_ts, payout_yes, diff FROM placed
  WHERE realized_bucket IS NOT NULL AND window_label = 'confirmatory'),
totals AS (
  SELECT model_id, venue, category, window_label, horizon, variant, count(*) AS n, avg(pow(p_yes - payout_yes, 2)) AS brier_model,
    avg(pow(p_market_at_ts - payout_yes, 2)) AS brier_market, avg(diff) AS skill,
    avg(-(payout_yes * ln(CLIP(p_yes)) + (1 - payout_yes) * ln(1 - CLIP(p_yes)))) AS log_loss_model,
    avg(-(payout_yes * ln(CLIP(p_market_at_ts)) + (1 - payout_yes) * ln(1 - CLIP(p_market_at_ts)))) AS log_loss_market
  FROM cells GROUP BY ALL),
spread AS (
  SELECT model_id, venue, category, window_label, horizon, variant, count(*) AS n_clusters, avg(d) AS m,
    stddev_samp(d) AS sd, coalesce(var_samp(d), 0e0) AS v
  FROM (SELECT model_id, venue, category, window_label, horizon, variant, cluster_id, avg(diff) AS d FROM cells GROUP BY ALL) GROUP BY ALL),
seq AS (
  SELECT *, 0.12177348869865692e0 * n_clusters AS rho,
    sqrt((n_clusters * v + 0.12177348869865692e0 * n_clusters) * ln((n_clusters * v + 0.12177348869865692e0 * n_clusters)
      / (5e-2 * 5e-2 * 0.12177348869865692e0 * n_clusters))) / n_clusters AS half FROM spread)
SELECT t.model_id, t.venue, t.category, t.window_label, t.horizon, t.variant, t.n, s.n_clusters, R(brier_model) AS brier_model,
  R(brier_market) AS brier_market, R(skill) AS skill, R(log_loss_model) AS log_loss_model, R(log_loss_market) AS log_loss_market,
  R(28e-1 * sd / sqrt(n_clusters)) AS mde, R(m) AS cs_center, R(m - half) AS cs_lo, R(m + half) AS cs_hi,
  CASE WHEN m - half <= 0 AND m + half >= 0 THEN 1 ELSE 0 END AS cs_covers_zero
FROM totals t JOIN seq s ON s.model_id = t.model_id AND s.venue = t.venue AND s.category = t.category
  AND s.window_label = t.window_label AND s.horizon = t.horizon AND s.variant = t.variant

-- name: paired_skill
SELECT t.*, R(28e-1 * s.sd / sqrt(t.n_clusters)) AS mde FROM (
  SELECT model_id, venue, count(*) AS n, count(DISTINCT cluster_id) AS n_clusters,
    R(avg(pow(p_yes - payout_yes, 2))) AS brier_model, R(avg(pow(p_market_at_ts - payout_yes, 2))) AS brier_market,
    R(avg(diff)) AS skill,
    R(avg(-(payout_yes * ln(CLIP(p_yes)) + (1 - payout_yes) * ln(1 - CLIP(p_yes))))) AS log_loss_model,
    R(avg(-(payout_yes * ln(CLIP(p_market_at_ts)) + (1 - payout_yes) * ln(1 - CLIP(p_market_at_ts))))) AS log_loss_market
  FROM fx_scored GROUP BY model_id, venue) t
JOIN (SELECT model_id, venue, stddev_samp(d) AS sd FROM (
        SELECT model_id, venue, cluster_id, avg(diff) AS d FROM fx_scored GROUP BY ALL) GROUP BY ALL) s
  ON s.model_id = t.model_id AND s.venue = t.venue

-- name: bootstrap_ci
WITH clusters AS (SELECT model_id, venue, cluster_id, count(*) AS n, sum(diff) AS s FROM fx_scored GROUP BY ALL),
d1 AS (SELECT model_id, venue, n, s, sha256(concat_ws('|', '7', model_id, venue, cluster_id)) AS t FROM clusters),
d2 AS (SELECT model_id, venue, n, s, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_id, venue, n, s, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_id, venue, n, s, rep, POISSON(u) AS w FROM d3) WHERE w > 0)
SELECT model_id, venue, R(quantile_cont(m, 25e-3)) AS ci_lo, R(quantile_cont(m, 975e-3)) AS ci_hi
FROM (SELECT model_id, venue, rep, sum(w * s) / sum(w * n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL

-- name: bootstrap_ci_poisson
WITH clusters AS (SELECT model_id, venue, cluster_id, count(*) AS n, sum(diff) AS s FROM fx_scored GROUP BY ALL),
d1 AS (SELECT model_id, venue, n, s, sha256(concat_ws('|', '7', model_id, venue, cluster_id)) AS t FROM clusters),
d2 AS (SELECT model_id, venue, n, s, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_id, venue, n, s, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_id, venue, n, s, rep, POISSON(u) AS w FROM d3) WHERE w > 0)
SELECT model_id, venue, R(quantile_cont(m, 25e-3)) AS ci_lo, R(quantile_cont(m, 975e-3)) AS ci_hi
FROM (SELECT model_id, venue, rep, sum(w * s) / sum(w * n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL

-- name: cluster_sequence
SELECT model_id, cluster_id, R(diff) AS diff, entry_s, n_rows,
  row_number() OVER (PARTITION BY model_id ORDER BY entry_s, cluster_id) AS seq
FROM (SELECT model_id, cluster_id, avg(diff) AS diff, min(entry_s) AS entry_s, count(*) AS n_rows FROM fx_scored GROUP BY ALL)

-- name: confidence_sequence
WITH cells AS (SELECT model_id, venue, count(*) AS n, avg(d) AS m, coalesce(var_samp(d), 0e0) AS v FROM (
    SELECT model_id, venue, cluster_id, avg(diff) AS d FROM fx_scored GROUP BY ALL) GROUP BY ALL),
h AS (SELECT *, sqrt((n * v + 0.12177348869865692e0 * n) * ln((n * v + 0.12177348869865692e0 * n)
    / (25e-4 * 0.12177348869865692e0 * n))) / n AS half FROM cells)
SELECT model_id, venue, n AS n_clusters, R(m) AS cs_center, R(m - half) AS cs_lo, R(m + half) AS cs_hi,
  CASE WHEN m - half <= 0 AND m + half >= 0 THEN 1 ELSE 0 END AS cs_covers_zero FROM h

-- name: confidence_path
WITH c AS (SELECT model_id, cluster_id, avg(diff) AS d, min(entry_s) AS entry_s FROM fx_scored GROUP BY ALL),
p AS (SELECT model_id, cluster_id, entry_s, row_number() OVER w AS t, avg(d) OVER w AS m,
    coalesce(var_samp(d) OVER w, 0e0) AS v, count(*) OVER (PARTITION BY model_id) AS nt
  FROM c WINDOW w AS (PARTITION BY model_id ORDER BY entry_s, cluster_id ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, sqrt((t * v + 0.12177348869865692e0 * nt) * ln((t * v + 0.12177348869865692e0 * nt)
    / (25e-4 * 0.12177348869865692e0 * nt))) / t AS half FROM p)
SELECT model_id, cluster_id, entry_s, t AS seq, R(m) AS cs_center, R(m - half) AS cs_lo, R(m + half) AS cs_hi FROM h

-- name: stratified_skill
WITH strata AS (
  SELECT model_id, venue, CASE WHEN p_market_at_ts < 5e-2 THEN 0 WHEN p_market_at_ts < 2e-1 THEN 1 WHEN p_market_at_ts < 4e-1 THEN 2
      WHEN p_market_at_ts < 6e-1 THEN 3 WHEN p_market_at_ts < 8e-1 THEN 4 WHEN p_market_at_ts < 95e-2 THEN 5 ELSE 6 END AS st,
    count(*) AS n, avg(diff) AS m, 1 / greatest(var_samp(diff) / count(*), 1e-12) AS w FROM fx_scored GROUP BY ALL)
SELECT model_id, venue, R(CASE WHEN count(*) FILTER (n >= 30) >= 3
    THEN sum(w * m) FILTER (n >= 30) / sum(w) FILTER (n >= 30) END) AS skill_pw, count(*) FILTER (n >= 30) AS n_strata
FROM strata GROUP BY ALL

-- name: stratified_ci
WITH moments AS (
  SELECT model_id, cluster_id, CASE WHEN p_market_at_ts < 5e-2 THEN 0 WHEN p_market_at_ts < 2e-1 THEN 1 WHEN p_market_at_ts < 4e-1 THEN 2
      WHEN p_market_at_ts < 6e-1 THEN 3 WHEN p_market_at_ts < 8e-1 THEN 4 WHEN p_market_at_ts < 95e-2 THEN 5 ELSE 6 END AS st,
    count(*) AS n, sum(diff) AS s, sum(diff * diff) AS q FROM fx_scored GROUP BY ALL),
d1 AS (SELECT model_id, st, n, s, q, sha256(concat_ws('|', '11', model_id, cluster_id)) AS t FROM moments),
d2 AS (SELECT model_id, st, n, s, q, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_id, st, n, s, q, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_id, st, n, s, q, rep, POISSON(u) AS w FROM d3) WHERE w > 0),
strata AS (SELECT model_id, rep, st, sum(w * n) AS n, sum(w * s) AS s, sum(w * q) AS q FROM drawn GROUP BY ALL),
weighed AS (SELECT *, s / n AS m, 1 / greatest((q - s * s / n) / (n - 1) / n, 1e-12) AS w FROM strata WHERE n >= 30),
reps AS (SELECT model_id, rep, CASE WHEN count(*) >= 3 THEN sum(w * m) / sum(w) END AS skill_pw FROM weighed GROUP BY ALL)
SELECT model_id, count(skill_pw) AS n_reps,
  R(CASE WHEN count(skill_pw) >= 1000 THEN quantile_cont(skill_pw, 25e-3) END) AS ci_lo,
  R(CASE WHEN count(skill_pw) >= 1000 THEN quantile_cont(skill_pw, 975e-3) END) AS ci_hi FROM reps GROUP BY ALL

-- name: calibration_bins
WITH cells AS (SELECT DISTINCT model_id, venue FROM fx_scored),
bins AS (SELECT i AS bin, i * 1e-1 AS bin_lo, CASE i WHEN 9 THEN 1e0 ELSE (i + 1) * 1e-1 END AS bin_hi FROM range(10) t(i))
SELECT c.model_id, c.venue, cast(b.bin AS integer) AS bin, R(b.bin_lo) AS bin_lo, R(b.bin_hi) AS bin_hi, count(s.p_yes) AS n,
  R(avg(s.p_yes)) AS p_mean, R(avg(s.payout_yes)) AS y_rate
FROM cells c CROSS JOIN bins b LEFT JOIN fx_scored s ON s.model_id = c.model_id AND s.venue = c.venue
  AND s.p_yes >= b.bin_lo AND (s.p_yes < b.bin_hi OR (b.bin = 9 AND s.p_yes <= 1)) GROUP BY ALL

-- name: bucketed_events
SELECT model_id, event_id, ts_s, verdict, k, winners, R(abs(sum_model - 1)) AS coherence_deviation FROM fx_bucket_verdicts

-- name: rps
SELECT model_id, event_id, k, R(rps_model) AS rps_model, R(rps_market) AS rps_market FROM fx_rps

-- name: rps_skill
WITH ev AS (SELECT *, event_id AS cluster_id, rps_market - rps_model AS s FROM fx_rps),
d1 AS (SELECT model_id, s, sha256(concat_ws('|', '0', model_id, cluster_id)) AS t FROM ev),
d2 AS (SELECT model_id, s, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_id, s, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_id, s, rep, POISSON(u) AS w FROM d3) WHERE w > 0),
ci AS (SELECT model_id, quantile_cont(m, 25e-3) AS lo, quantile_cont(m, 975e-3) AS hi FROM (
  SELECT model_id, rep, sum(w * s) / sum(w) AS m FROM drawn GROUP BY ALL) GROUP BY ALL)
SELECT e.model_id, count(*) AS n_events, R(avg(rps_model)) AS rps_model, R(avg(rps_market)) AS rps_market, R(avg(s)) AS skill_rps,
  R(max(lo)) AS ci_lo, R(max(hi)) AS ci_hi FROM ev e JOIN ci ON ci.model_id = e.model_id GROUP BY e.model_id HAVING count(*) >= 20

-- name: taker_rate
SELECT forecast_id, venue, category, R(taker_rate) AS taker_rate FROM fx_rated

-- name: net_growth
WITH a AS (SELECT *, p_yes > p_market_at_ts AS yes FROM fx_rated),
b AS (SELECT *, CASE WHEN yes THEN p_yes ELSE 1 - p_yes END AS q,
    CASE WHEN yes THEN p_market_at_ts ELSE 1 - p_market_at_ts END + greatest(0e0, spread_at_ts) / 2 AS touch FROM a),
c AS (SELECT *, touch * (1 + taker_rate * (1 - touch)) AS cost FROM b),
d AS (SELECT *, CASE WHEN cost > 0 AND cost < 1 AND (q - cost) / (1 - cost) > 0 THEN least((q - cost) / (1 - cost) * 2e-1, 5e-2) ELSE 0e0 END AS f FROM c),
g AS (SELECT *, CASE WHEN f > 0 THEN CASE WHEN (payout_yes = 1) = yes THEN ln(1 - f + f / cost) ELSE ln(1 - f) END ELSE 0e0 END AS growth FROM d),
k AS (SELECT model_id, venue, cluster_id, avg(growth) AS g, count(*) FILTER (f > 0) AS bets, count(*) AS n FROM g GROUP BY ALL),
z AS (SELECT model_id, venue, count(*) AS n_clusters, avg(g) AS m, coalesce(var_samp(g), 0e0) AS v, sum(bets) / sum(n) AS share FROM k GROUP BY ALL),
h AS (SELECT *, sqrt((n_clusters * v + 0.12177348869865692e0 * n_clusters) * ln((n_clusters * v + 0.12177348869865692e0 * n_clusters)
    / (25e-4 * 0.12177348869865692e0 * n_clusters))) / n_clusters AS half FROM z)
SELECT model_id, venue, n_clusters, R(m) AS net_growth, R(share) AS net_bet_share, R(m - half) AS net_lo, R(m + half) AS net_hi,
  CASE WHEN m - half <= 0 AND m + half >= 0 THEN 1 ELSE 0 END AS net_covers_zero FROM h

-- name: quote_asof
SELECT forecast_id, condition_id, target_s, quote_s, R(mid) AS mid FROM fx_asof24

-- name: drift
WITH f AS (SELECT *, CASE WHEN forecast_id % 2 = 0 THEN 'm1_debiased' ELSE 'm4_ensemble' END AS model_id FROM fx_drift_forecasts),
wide AS (SELECT n.*, h AS horizon, n.ts_s + h * 3600 AS target_s FROM f n, (VALUES (24), (72)) v(h) WHERE abs(p_yes - p_market_at_ts) >= 1e-9),
gapped AS (SELECT w.*, EXISTS (SELECT 1 FROM fx_gaps g WHERE w.ts_s < g.gap_end_s AND g.gap_start_s < w.target_s) AS in_gap FROM wide w),
hit AS (SELECT g.model_id, g.horizon, g.in_gap, g.p_yes, g.p_market_at_ts, CASE WHEN NOT g.in_gap THEN (
    SELECT arg_min(s.mid, abs(s.ts_s - g.target_s) * 2 + CASE WHEN s.ts_s > g.target_s THEN 1 ELSE 0 END) FROM fx_snapshots s
    WHERE s.condition_id = g.condition_id AND s.ts_s BETWEEN g.target_s - 10800 AND g.target_s + 10800) END AS mid FROM gapped g)
SELECT model_id, horizon, count(mid) AS n, R(avg(sign(p_yes - p_market_at_ts) * (mid - p_market_at_ts))) AS mean_signed_drift,
  count(*) FILTER (in_gap) AS dropped_for_gap FROM hit GROUP BY ALL

-- name: drift_trust
WITH r AS (SELECT sign(p_yes - p_market_at_ts) * (mid - p_market_at_ts) AS drift,
    pow(p_market_at_ts - y, 2) - pow(p_yes - y, 2) AS skill
  FROM (SELECT *, CASE WHEN forecast_id * 7 % 10 < 4 THEN 1e0 ELSE 0e0 END AS y FROM fx_asof24)
  WHERE abs(p_yes - p_market_at_ts) >= 1e-9 AND cast(substr(condition_id, 2) AS bigint) % 3 = 0
    AND condition_id IN (SELECT concat('s', c_custkey) FROM customer))
SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 'no_data' WHEN count(*) < 30 THEN 'insufficient_n' ELSE 'checked' END AS reason,
  R(CASE WHEN count(*) >= 30 THEN corr(drift, skill) END) AS correlation,
  CASE WHEN count(*) >= 30 AND abs(corr(drift, skill)) > 15e-2 THEN 0 ELSE 1 END AS trusted FROM r

-- name: eval_latest
SELECT run_id, ts_s, model_id, window_label, venue, category, n_event_clusters, R(skill) AS skill, R(mde) AS mde, R(rps) AS rps,
  R(net_growth) AS net_growth FROM fx_eval_latest
