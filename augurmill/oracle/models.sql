-- name: m1_recalibrated
SELECT condition_id, s.bucket, R(p_market) AS p_market, R(least(99e-2, greatest(1e-2, SIGMOID(alpha + beta * LOGIT(p_market))))) AS p_yes
FROM fx_states s JOIN fx_curves c ON c.bucket = s.bucket

-- name: m1_hier_recalibrated
SELECT condition_id, s.venue, s.bucket, R(least(99e-2, greatest(1e-2,
  SIGMOID(alpha + coalesce(alpha_offset, 0) + (beta + coalesce(beta_offset, 0)) * LOGIT(p_market))))) AS p_yes
FROM fx_states s JOIN fx_curves c ON c.bucket = s.bucket LEFT JOIN fx_offsets o ON o.bucket = s.bucket AND o.venue = s.venue

-- name: m2_blended
SELECT condition_id, s.category, R(least(99e-2, greatest(1e-2, SIGMOID(85e-2 * LOGIT(p_market) + 15e-2 * LOGIT(base_rate))))) AS p_yes
FROM fx_states s JOIN fx_base_rates b ON b.category = s.category

-- name: m3_evidence_score
WITH st AS (SELECT condition_id, end_s - 30 * 86400 AS forecast_s, 3e-2 + 94e-2 * ((k * 31 % 997) / 996e0) AS p_market FROM fx_markets),
d AS (SELECT condition_id, CASE WHEN l_partkey % 9 = 0 OR EPOCH(l_shipdate) > forecast_s THEN 0e0 ELSE
    15e-2 * (1 + l_linenumber % 3) * (1 + l_suppkey % 3) * least(1e0, l_discount * 10) * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN -1 ELSE 0 END
    * exp(-(forecast_s - EPOCH(l_shipdate)) / 86400e0 / 5e0) END AS delta
  FROM lineitem JOIN st ON condition_id = concat('m', l_orderkey)),
t AS (SELECT condition_id, count(*) AS n_items, sum(delta) AS total FROM d GROUP BY ALL)
SELECT t.condition_id, n_items, R(total) AS total_shift, R(least(8e-1, greatest(-8e-1, total))) AS clipped_shift,
  R(least(99e-2, greatest(1e-2, SIGMOID(LOGIT(p_market) + least(8e-1, greatest(-8e-1, total)))))) AS p_yes
FROM t JOIN st ON st.condition_id = t.condition_id

-- name: m4_pool
SELECT p.condition_id, day, p.category, n AS n_members, R(raw_logit) AS raw_logit,
  R(least(99e-2, greatest(1e-2, SIGMOID((1 + (coalesce(a, 1e0) - 1) * (n / (1 + (n - 1) * coalesce(rho_bar, 0e0)) - 1) / (n - 1)) * raw_logit)))) AS p_yes
FROM fx_pooled p LEFT JOIN fx_exponents e ON e.category = p.category

-- name: m5_threshold_share
SELECT condition_id, n AS n_members, R((CASE WHEN k % 2 = 1 THEN up ELSE n - up END + 1) / (n + 2)) AS p_yes FROM (
  SELECT m.condition_id, m.k, count(*) AS n, count(*) FILTER (l_quantity > 10 + m.k % 30) AS up FROM lineitem JOIN fx_markets m ON m.k = l_orderkey GROUP BY ALL)
WHERE n >= 5

-- name: m5_normal_tail
WITH z AS (SELECT concat('q', c_custkey) AS condition_id, c_custkey % 2 AS above,
    (c_acctbal / 2000e0 - 1 - n_nationkey / 10e0) / (3e-1 + n_regionkey / 10e0) AS z FROM customer JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT *, abs(z) / sqrt(2e0) AS x, 1 / (1 + 3275911e-7 * abs(z) / sqrt(2e0)) AS t FROM z),
e AS (SELECT *, 1 - t * (254829592e-9 + t * (-284496736e-9 + t * (1421413741e-9 + t * (-1453152027e-9 + t * 1061405429e-9)))) * exp(-x * x) AS erf FROM t),
c AS (SELECT *, CASE WHEN z >= 0 THEN 5e-1 * (1 + erf) ELSE 5e-1 * (1 - erf) END AS cdf FROM e)
SELECT condition_id, R(least(99e-2, greatest(1e-2, CASE above WHEN 1 THEN 1 - cdf ELSE cdf END))) AS p_yes FROM c

-- name: m6_coherence
WITH legs AS (SELECT u.condition_id, event_id, CASE WHEN 915220800 - q.ts_s <= 60 * CASE tier WHEN 'liquid' THEN 15 ELSE 90 END THEN mid END AS p
  FROM fx_universe u LEFT JOIN fx_latest q ON q.condition_id = u.condition_id WHERE event_id IS NOT NULL AND venue = 'polymarket' AND active = 1),
e AS (SELECT event_id, count(*) AS n_legs, sum(p) AS s FROM legs GROUP BY event_id HAVING count(*) = count(p) AND count(*) >= 2 AND abs(sum(p) - 1) > 3e-2)
SELECT condition_id, l.event_id, n_legs, R(p) AS p_market, R(s - 1) AS deviation, R(p / s) AS p_yes FROM legs l JOIN e ON e.event_id = l.event_id
WHERE abs(p / s - p) >= 1e-2

-- name: m6_implication
WITH p AS (SELECT u.k, u.condition_id, mid AS p FROM fx_universe u JOIN fx_latest q ON q.condition_id = u.condition_id
  WHERE mid IS NOT NULL AND 915220800 - q.ts_s <= 60 * CASE tier WHEN 'liquid' THEN 15 ELSE 90 END),
bad AS (SELECT n.condition_id AS narrow, b.condition_id AS broad, n.p AS pn, b.p AS pb FROM p n JOIN p b ON b.k = n.k + 1 WHERE n.k % 5 <> 0 AND n.p - b.p > 3e-2)
SELECT narrow, broad, narrow AS condition_id, R(pn) AS p_market, R((pn + pb) / 2) AS p_yes FROM bad
UNION ALL SELECT narrow, broad, broad, R(pb), R((pn + pb) / 2) FROM bad

-- name: m7_cross_pool
WITH q AS (SELECT m.condition_id, v.venue, s.bucket, CASE v.venue WHEN 'kalshi' THEN (m.k * 17 % 101) / 100e0 ELSE (m.k * 29 % 97) / 96e0 END AS price
  FROM fx_markets m JOIN fx_states s ON s.condition_id = m.condition_id, (VALUES ('kalshi'), ('metaculus')) v(venue)),
r AS (SELECT q.condition_id, CASE WHEN q.venue = 'metaculus' AND alpha IS NOT NULL
    THEN SIGMOID(alpha + coalesce(alpha_offset, 0) + (beta + coalesce(beta_offset, 0)) * LOGIT(price)) ELSE price END AS p
  FROM q LEFT JOIN fx_curves c ON c.bucket = q.bucket LEFT JOIN fx_offsets o ON o.bucket = q.bucket AND o.venue = q.venue),
g AS (SELECT condition_id, count(*) AS n, avg(LOGIT(p)) AS l FROM r WHERE p > 0 AND p < 1 GROUP BY ALL)
SELECT condition_id, n AS n_pooled, R(l) AS raw_logit, R(least(99e-2, greatest(1e-2,
  SIGMOID(CASE WHEN n <= 1 THEN 1e0 ELSE 1 + 5e-1 * (n / (1 + (n - 1) * 4e-1) - 1) / greatest(n - 1, 1) END * l)))) AS p_yes FROM g

-- name: pair_state
WITH v AS (SELECT concat('m', l_orderkey) AS condition_id, CASE l_suppkey % 2 WHEN 0 THEN 'kalshi' ELSE 'metaculus' END AS venue,
  concat('x', l_orderkey % 50) AS external_id, CASE WHEN l_partkey % 7 = 0 THEN 'confirmed' WHEN l_partkey % 3 = 0 THEN 'rejected' ELSE 'proposed' END AS status,
  EPOCH(l_shipdate) AS ts_s, concat(l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(round(l_extendedprice * 100) AS bigint)) AS vid FROM lineitem)
SELECT condition_id, venue, external_id, CASE WHEN bool_or(status = 'confirmed') THEN 'confirmed' ELSE arg_max(status, (ts_s, vid)) END AS status,
  min(ts_s) FILTER (status = 'confirmed') AS confirmed_s FROM v GROUP BY ALL
