-- name: isotonic_bins
WITH p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_market, obs_id) - 1 AS spot, count(*) OVER (PARTITION BY bucket) AS m,
    least(20, greatest(1, count(*) OVER (PARTITION BY bucket) // 10)) AS k FROM fx_obs),
o AS (SELECT *, CASE WHEN spot < m % k * (m // k + 1) THEN spot // (m // k + 1) ELSE m % k + (spot - m % k * (m // k + 1)) // (m // k) END AS bin FROM p),
b AS (SELECT bucket, bin, avg(p_market) AS c, avg(outcome) AS e, count(*) AS n FROM o GROUP BY ALL),
spans AS (SELECT i.bucket, i.bin AS i, j.bin AS j, sum(m.e * m.n) / sum(m.n) AS mean FROM b i JOIN b j ON j.bucket = i.bucket AND j.bin >= i.bin
  JOIN b m ON m.bucket = i.bucket AND m.bin BETWEEN i.bin AND j.bin GROUP BY ALL),
lows AS (SELECT s.bucket, s.i, k.bin, min(mean) AS low FROM spans s JOIN b k ON k.bucket = s.bucket AND k.bin BETWEEN s.i AND s.j GROUP BY ALL),
iso AS (SELECT bucket, bin, max(low) AS isotonic FROM lows GROUP BY ALL)
SELECT b.bucket, cast(b.bin AS integer) AS bin, R(c) AS p_center, R(e) AS empirical, n, R(isotonic) AS isotonic,
  R(abs(SIGMOID(alpha + beta * LOGIT(c)) - isotonic)) AS deviation
FROM b JOIN iso ON iso.bucket = b.bucket AND iso.bin = b.bin LEFT JOIN fx_curves k ON k.bucket = b.bucket

-- name: fit_base_rates
WITH live AS (SELECT r.condition_id, m.category, r.payout_yes AS outcome FROM fx_resolutions r JOIN fx_markets m ON m.condition_id = r.condition_id
  WHERE disputed = 0 AND resolved_s >= 883612800),
train AS (SELECT condition_id, arg_min(category, obs_day) AS category, arg_min(outcome, obs_day) AS outcome FROM fx_training GROUP BY 1),
both_sets AS (SELECT * FROM live UNION ALL SELECT * FROM train WHERE condition_id NOT IN (SELECT condition_id FROM live))
SELECT category, count(*) AS n, R(CASE WHEN category IS NOT NULL THEN avg(outcome) END) AS base_rate FROM both_sets GROUP BY category
HAVING count(*) >= 50 OR category IS NULL

-- name: fit_pool_weights
WITH RECURSIVE m AS (SELECT category, model_id, avg(pow(p_yes - payout_yes, 2)) AS brier, count(*) AS n FROM fx_scored
  WHERE model_id <> 'm4_ensemble' AND category IS NOT NULL GROUP BY ALL),
p AS (SELECT category, list(model_id ORDER BY model_id) AS ids, list(exp(-brier / 5e-2) ORDER BY model_id) AS e, I(sum(n)) AS n FROM m GROUP BY category HAVING sum(n) >= 100),
w AS (SELECT category, ids, n, list_transform(e, lambda x : x / list_sum(e)) AS raw, list_transform(e, lambda x : x / list_sum(e)) AS v, 0 AS i FROM p
  UNION ALL
  SELECT category, ids, n, raw, list_transform(c, lambda x : x / list_sum(c)), i + 1 FROM (
    SELECT *, list_transform(v, lambda x : least(6e-1, greatest(2e-2, x))) AS c FROM w WHERE i < 200))
SELECT category, unnest(ids) AS model_id, R(unnest(raw)) AS raw, R(unnest(list_transform(v, lambda x : least(6e-1, greatest(2e-2, x))))) AS weight, n AS n_resolved
FROM w WHERE i = 200

-- name: pair_correlation
SELECT category, a, b, n, R(rho) AS rho FROM fx_pair_rho

-- name: mean_correlation
SELECT category, R(avg(rho)) AS rho_bar, count(*) AS n_pairs FROM fx_pair_rho GROUP BY category

-- name: daily_pair_correlation
WITH d AS (SELECT condition_id, DAYNUM(ts_s) AS day, LOGIT(arg_max(mid, ts_s)) AS lg FROM fx_snapshots GROUP BY ALL),
u AS (SELECT DISTINCT user_id FROM events)
SELECT x.condition_id AS a, y.condition_id AS b, count(*) AS n_days, R(corr(x.lg, y.lg)) AS rho FROM u
JOIN d x ON x.condition_id = concat('s', user_id) JOIN d y ON y.condition_id = concat('s', user_id + 1) AND y.day = x.day
GROUP BY ALL HAVING count(*) >= 10

-- name: fit_exponent
WITH r AS (SELECT coalesce(category, 'unknown') AS category, LOGIT(p_yes) AS lg, payout_yes AS y,
    row_number() OVER (PARTITION BY coalesce(category, 'unknown') ORDER BY entry_s, forecast_id) AS pos,
    count(*) OVER (PARTITION BY coalesce(category, 'unknown')) AS n FROM fx_scored WHERE model_id = 'm4_ensemble'),
s AS (SELECT category, a, avg(pow(SIGMOID(a * lg) - y, 2)) FILTER (pos <= floor(8e-1 * n)) AS train_brier,
    avg(pow(SIGMOID(a * lg) - y, 2)) FILTER (pos > floor(8e-1 * n)) AS validation_brier,
    count(*) FILTER (pos <= floor(8e-1 * n)) AS n_train, count(*) FILTER (pos > floor(8e-1 * n)) AS n_validation
  FROM r, (VALUES (1e0), (125e-2), (15e-1), (175e-2), (2e0), (225e-2), (25e-1)) g(a) WHERE n >= 60 GROUP BY ALL)
SELECT category, a, R(train_brier) AS train_brier, R(validation_brier) AS validation_brier, n_train, n_validation FROM s
QUALIFY row_number() OVER (PARTITION BY category ORDER BY s.train_brier, a) = 1

-- name: fit_evidence_params
WITH st AS (SELECT m.condition_id, end_s - 2592000 AS forecast_s, 3e-2 + 94e-2 * ((k * 31 % 997) / 996e0) AS p_market, payout_yes AS y,
    row_number() OVER (ORDER BY resolved_s, m.condition_id) AS pos, count(*) OVER () AS n
  FROM fx_markets m JOIN fx_resolutions r ON r.condition_id = m.condition_id WHERE disputed = 0),
tr AS (SELECT *, floor((pos - 1) / greatest(1, floor(floor(8e-1 * n) / 5))) AS fold FROM st WHERE pos <= floor(8e-1 * n)),
d AS (SELECT condition_id, tau, sum(CASE WHEN l_partkey % 9 = 0 OR EPOCH(l_shipdate) > forecast_s THEN 0e0 ELSE
    (1 + l_linenumber % 3) * (1 + l_suppkey % 3) * least(1e0, l_discount * 10) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN -1 ELSE 0 END
    * exp(-(forecast_s - EPOCH(l_shipdate)) / 86400e0 / tau) END) AS s
  FROM lineitem JOIN tr ON condition_id = concat('m', l_orderkey), (VALUES (3e0), (5e0), (10e0)) t(tau) GROUP BY ALL),
f AS (SELECT k, t.tau, cap, fold, avg(pow(SIGMOID(LOGIT(p_market) + least(cap, greatest(-cap, k * coalesce(d.s, 0)))) - y, 2)) AS brier
  FROM tr CROSS JOIN (VALUES (3e0), (5e0), (10e0)) t(tau) CROSS JOIN (VALUES (8e-2), (15e-2), (25e-2)) g(k) CROSS JOIN (VALUES (5e-1), (8e-1), (12e-1)) c(cap)
  LEFT JOIN d ON d.condition_id = tr.condition_id AND d.tau = t.tau WHERE fold BETWEEN 1 AND 4 GROUP BY ALL)
SELECT R(k) AS k, tau AS tau_days, R(cap) AS max_shift, R(avg(brier)) AS score, count(*) AS n_folds FROM f GROUP BY k, tau, cap

-- name: surprise_pairs
SELECT series, period, R(nowcast) AS nowcast, R(actual) AS actual, R(actual - nowcast) AS surprise FROM fx_surprises

-- name: fit_surprise_sd
WITH a AS (SELECT series, actual - nowcast AS s, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS age, count(*) OVER (PARTITION BY series) AS n FROM fx_surprises),
f AS (SELECT series, greatest(stddev_samp(s) FILTER (age > 8), 1e-6) AS sd, count(*) FILTER (age > 8) AS n_train,
  count(*) FILTER (age <= 8) AS n_validation, sum(s * s) FILTER (age <= 8) AS ss FROM a WHERE n >= 12 GROUP BY series)
SELECT series, R(sd) AS sd, n_train, n_validation, R(n_validation * 5e-1 * ln(2 * pi() * sd * sd) + ss / (2 * sd * sd)) AS val_nll FROM f

-- name: pool_replay_rows
SELECT condition_id, category, model_id, R(p_yes) AS p_yes, n_members, outcome, pool_s FROM fx_replay_members

-- name: replay
SELECT model_key, row_id, version, R(p) AS p FROM fx_replayed

-- name: gate
WITH c AS (SELECT model_key, cluster_id, avg(diff) AS m, count(*) AS n, sum(diff) AS s FROM fx_gate_rows GROUP BY ALL),
d1 AS (SELECT model_key, n, s, sha256(concat_ws('|', '0', model_key, cluster_id)) AS t FROM c),
d2 AS (SELECT model_key, n, s, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_key, n, s, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_key, n, s, rep, POISSON(u) AS w FROM d3) WHERE w > 0),
ci AS (SELECT model_key, quantile_cont(m, 25e-3) AS lo, quantile_cont(m, 975e-3) AS hi FROM (
  SELECT model_key, rep, sum(w * s) / sum(w * n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL),
z AS (SELECT model_key, count(*) AS nc, sum(s) / sum(n) AS skill, avg(m) AS mu, coalesce(var_samp(m), 0e0) AS v FROM c GROUP BY ALL),
h AS (SELECT *, sqrt((nc * v + 0.12177348869865692e0 * nc) * ln((nc * v + 0.12177348869865692e0 * nc) / (25e-4 * 0.12177348869865692e0 * nc))) / nc AS half FROM z)
SELECT h.model_key, nc AS n_clusters, R(skill) AS skill, R(mu - half) AS cs_lo, R(mu + half) AS cs_hi, R(lo) AS ci_lo, R(hi) AS ci_hi,
  CASE WHEN nc < 200 THEN 'insufficient_n' WHEN mu - half > 0 THEN 'better' ELSE 'not_better' END AS reason,
  CASE WHEN nc >= 200 AND mu - half > 0 THEN 1 ELSE 0 END AS promoted
FROM h JOIN ci ON ci.model_key = h.model_key

-- name: rollback_check
WITH last AS (SELECT * FROM fx_gate_rows WHERE model_key = 'm1_curves' ORDER BY entry_s DESC, row_id DESC LIMIT 50),
c AS (SELECT model_key, cluster_id, avg(diff) AS m, count(*) AS n, sum(diff) AS s FROM last GROUP BY ALL),
d1 AS (SELECT model_key, n, s, sha256(concat_ws('|', '0', model_key, cluster_id)) AS t FROM c),
d2 AS (SELECT model_key, n, s, b AS rep, (H(t) + b * 1140671485) % 2147483647 AS x, G(t) AS g FROM d1, range(1, 2001) r(b)),
d3 AS (SELECT model_key, n, s, rep, (FIFTH(x) + g) % 2147483647 / 2147483647e0 AS u FROM d2),
drawn AS (SELECT * FROM (SELECT model_key, n, s, rep, POISSON(u) AS w FROM d3) WHERE w > 0),
ci AS (SELECT model_key, quantile_cont(m, 25e-3) AS lo, quantile_cont(m, 975e-3) AS hi FROM (
  SELECT model_key, rep, sum(w * s) / sum(w * n) AS m FROM drawn GROUP BY ALL) GROUP BY ALL),
z AS (SELECT model_key, count(*) AS nc, sum(s) / sum(n) AS skill, avg(m) AS mu, coalesce(var_samp(m), 0e0) AS v FROM c GROUP BY ALL),
h AS (SELECT *, sqrt((nc * v + 0.12177348869865692e0 * nc) * ln((nc * v + 0.12177348869865692e0 * nc) / (25e-4 * 0.12177348869865692e0 * nc))) / nc AS half FROM z)
SELECT h.model_key, nc AS n_clusters, R(skill) AS skill, R(mu - half) AS cs_lo, R(mu + half) AS cs_hi, R(lo) AS ci_lo, R(hi) AS ci_hi,
  CASE WHEN nc >= 2 AND mu - half > 0 THEN 1 ELSE 0 END AS degraded FROM h JOIN ci ON ci.model_key = h.model_key

-- name: fit_recalibration
WITH RECURSIVE th AS (
  SELECT bucket, 0e0 AS a, 1e0 AS b, 0 AS i, count(*) AS n, 0e0 AS nll FROM fx_obs GROUP BY bucket HAVING count(*) >= 100
  UNION ALL
  SELECT bucket, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), i + 1, n, l FROM (
    SELECT o.bucket, a, b, i, t.n, sum(outcome - p) AS g0, sum((outcome - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
      sum(p * (1 - p) * x * x) AS h11, sum(-(outcome * ln(CLIP(p)) + (1 - outcome) * ln(1 - CLIP(p)))) AS l
    FROM (SELECT bucket, outcome, LOGIT(p_market) AS x FROM fx_obs) o JOIN th t ON t.bucket = o.bucket, LATERAL (SELECT SIGMOID(a + b * x) AS p)
    WHERE i < 20 GROUP BY ALL))
SELECT bucket, R(a) AS alpha, R(b) AS beta, n, R(nll) AS nll FROM th WHERE i = 20

-- name: fit_hier
-- Newton from the plain curve; 2x2 blocks eliminated by venue.
WITH RECURSIVE size AS (SELECT bucket, venue, count(*) AS nv, sum(count(*)) OVER (PARTITION BY bucket) AS nb FROM fx_obs GROUP BY bucket, venue),
plain AS (
  SELECT bucket, 0e0 AS a, 1e0 AS b, 0 AS i FROM fx_obs GROUP BY bucket HAVING count(*) >= 100
  UNION ALL
  SELECT bucket, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), i + 1 FROM (
    SELECT o.bucket, a, b, i, sum(outcome - p) AS g0, sum((outcome - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
    FROM (SELECT bucket, outcome, LOGIT(p_market) AS x FROM fx_obs) o JOIN plain t ON t.bucket = o.bucket, LATERAL (SELECT SIGMOID(a + b * x) AS p)
    WHERE i < 15 GROUP BY ALL)),
th AS (
  SELECT s.bucket, s.venue, a AS ag, b AS bg, 0e0 AS av, 0e0 AS bv, 0 AS i, nv, cast(nb AS bigint) AS nb, CASE WHEN nv >= 5 THEN 2e0 * nb / nv END AS lam FROM size s JOIN plain p ON p.bucket = s.bucket AND p.i = 15
  UNION ALL
  SELECT bucket, venue, ag + dga, bg + dgb,
    CASE WHEN lam IS NULL THEN 0e0 ELSE av + (m11 * (e0 - h00 * dga - h01 * dgb) - h01 * (e1 - h01 * dga - h11 * dgb)) / det END,
    CASE WHEN lam IS NULL THEN 0e0 ELSE bv + (m00 * (e1 - h01 * dga - h11 * dgb) - h01 * (e0 - h00 * dga - h01 * dgb)) / det END, i + 1, nv, nb, lam
  FROM (SELECT *, (s11 * r0 - s01 * r1) / (s00 * s11 - s01 * s01) AS dga, (s00 * r1 - s01 * r0) / (s00 * s11 - s01 * s01) AS dgb FROM (
    SELECT *, sum(c00) OVER w AS s00, sum(c01) OVER w AS s01, sum(c11) OVER w AS s11, sum(q0) OVER w AS r0, sum(q1) OVER w AS r1 FROM (
      SELECT *,
        CASE WHEN lam IS NULL THEN h00 ELSE h00 - (h00 * (m11 * h00 - h01 * h01) + h01 * (m00 * h01 - h01 * h00)) / det END AS c00,
        CASE WHEN lam IS NULL THEN h01 ELSE h01 - (h00 * (m11 * h01 - h01 * h11) + h01 * (m00 * h11 - h01 * h01)) / det END AS c01,
        CASE WHEN lam IS NULL THEN h11 ELSE h11 - (h01 * (m11 * h01 - h01 * h11) + h11 * (m00 * h11 - h01 * h01)) / det END AS c11,
        CASE WHEN lam IS NULL THEN g0 ELSE g0 - (h00 * (m11 * e0 - h01 * e1) + h01 * (m00 * e1 - h01 * e0)) / det END AS q0,
        CASE WHEN lam IS NULL THEN g1 ELSE g1 - (h01 * (m11 * e0 - h01 * e1) + h11 * (m00 * e1 - h01 * e0)) / det END AS q1
      FROM (SELECT *, h00 + lam AS m00, h11 + lam AS m11, (h00 + lam) * (h11 + lam) - h01 * h01 AS det, g0 - lam * av AS e0, g1 - lam * bv AS e1 FROM (
        SELECT o.bucket, o.venue, ag, bg, av, bv, i, nv, nb, lam, sum(outcome - p) AS g0, sum((outcome - p) * x) AS g1, sum(p * (1 - p)) AS h00,
          sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
        FROM (SELECT bucket, venue, outcome, LOGIT(p_market) AS x FROM fx_obs) o JOIN th t ON t.bucket = o.bucket AND t.venue = o.venue,
          LATERAL (SELECT SIGMOID(ag + av + (bg + bv) * x) AS p) WHERE i < 25 GROUP BY ALL)))
    WINDOW w AS (PARTITION BY bucket))))
SELECT bucket, venue, R(av) AS alpha, R(bv) AS beta, nv AS n FROM th WHERE i = 25 AND lam IS NOT NULL
UNION ALL SELECT DISTINCT bucket, NULL, R(ag), R(bg), nb FROM th WHERE i = 25

-- name: mwu_weights
-- The bounds have a closed form here: at most one group of correlated models
-- is above the ceiling, and no weight is below the floor.
WITH RECURSIVE m AS (SELECT e.*, count(*) OVER w AS nm, sum(n) OVER w AS nr, max(n) OVER w AS t FROM fx_experts e WHERE model_id <> 'm4_ensemble'
  WINDOW w AS (PARTITION BY category)),
ok AS (SELECT *, exp(sqrt(8 * ln(nm) / t) * avg_lw) AS e FROM m WHERE nm >= 2 AND nr >= 100),
raw AS (SELECT category, model_id, nm, nr, e / sum(e) OVER (PARTITION BY category) AS raw FROM ok),
links AS (SELECT category, a, b FROM fx_pair_rho WHERE rho >= 8e-1 UNION ALL SELECT category, b, a FROM fx_pair_rho WHERE rho >= 8e-1),
reach AS (SELECT category, model_id, model_id AS label FROM raw UNION SELECT r.category, l.b, r.label FROM reach r JOIN links l ON l.category = r.category AND l.a = r.model_id),
grp AS (SELECT category, model_id, min(label) AS g FROM reach GROUP BY ALL),
sums AS (SELECT r.*, g, sum(raw) OVER (PARTITION BY r.category, g) AS gs, count(*) OVER (PARTITION BY r.category, g) AS gn FROM raw r
  JOIN grp ON grp.category = r.category AND grp.model_id = r.model_id),
top AS (SELECT *, max(gs) OVER (PARTITION BY category) AS mx, max(gn) OVER (PARTITION BY category) AS mg FROM sums)
SELECT category, model_id, R(raw) AS raw, R(CASE WHEN mg = nm THEN 1e0 / nm WHEN mx <= 6e-1 THEN raw WHEN gs = mx THEN raw * 6e-1 / mx ELSE raw * 4e-1 / (1 - mx) END) AS weight,
  I(nr) AS n_resolved FROM top

-- name: bounded_steps
WITH sd_old AS (SELECT DISTINCT series, (1 + cast(substr(series, 2) AS bigint) % 5) / 10e0 AS sd FROM fx_surprises),
hier_old AS (SELECT bucket, NULL AS venue, alpha, beta FROM fx_curves UNION ALL SELECT bucket, venue, alpha_offset, beta_offset FROM fx_offsets),
moves AS (
  SELECT 'curves' AS kind, f.bucket AS name, 'alpha' AS parameter, f.alpha AS new, o.alpha AS old FROM q_fit_recalibration f LEFT JOIN fx_curves o ON o.bucket = f.bucket
  UNION ALL SELECT 'curves', f.bucket, 'beta', f.beta, o.beta FROM q_fit_recalibration f LEFT JOIN fx_curves o ON o.bucket = f.bucket
  UNION ALL SELECT 'hier', concat(f.bucket, '|', f.venue), 'alpha', f.alpha, o.alpha FROM q_fit_hier f LEFT JOIN hier_old o ON o.bucket = f.bucket AND o.venue IS NOT DISTINCT FROM f.venue
  UNION ALL SELECT 'hier', concat(f.bucket, '|', f.venue), 'beta', f.beta, o.beta FROM q_fit_hier f LEFT JOIN hier_old o ON o.bucket = f.bucket AND o.venue IS NOT DISTINCT FROM f.venue
  UNION ALL SELECT 'weights', concat(f.category, '|', f.model_id), 'weight', f.weight, o.weight FROM q_fit_pool_weights f
    LEFT JOIN fx_weights o ON o.category = f.category AND o.model_id = f.model_id
  UNION ALL SELECT 'exponents', f.category, 'a', f.a, o.a FROM q_fit_exponent f LEFT JOIN fx_exponents o ON o.category = f.category
  UNION ALL SELECT 'surprise_sd', f.series, 'sd', f.sd, o.sd FROM q_fit_surprise_sd f LEFT JOIN sd_old o ON o.series = f.series)
SELECT kind, name, parameter, R(CASE WHEN old IS NULL OR old = 0 THEN new ELSE least(old + abs(old) / 5e0, greatest(old - abs(old) / 5e0, new)) END) AS value FROM moves
