-- name: kelly_delta
SELECT forecast_id, side, R(price) AS price, R(f) AS kelly, R(delta) AS log_wealth_delta FROM fx_delta

-- name: wealth_ledger
SELECT model_id, category, forecast_id, R(kelly) AS kelly, R(cum) AS cum_log_wealth, n AS n_forecasts FROM fx_wealth

-- name: expert_ranking
SELECT model_id, category, R(cum) AS cum_log_wealth, n AS n_forecasts, R(avg_lw) AS avg_log_wealth,
  cast(rank() OVER (PARTITION BY category ORDER BY avg_lw DESC) AS integer) AS rank FROM fx_experts

-- name: drawdown
SELECT forecast_id, R(cum) AS cum_log_wealth, R(max(cum) OVER w) AS peak, R(cum - max(cum) OVER w) AS drawdown FROM fx_wealth
WINDOW w AS (PARTITION BY model_id, category ORDER BY n ROWS UNBOUNDED PRECEDING)

-- name: wealth_bands
WITH p AS (SELECT model_id, cat AS category, b, sum(delta) OVER w AS cum, row_number() OVER w AS step FROM fx_delta, range(1, 501) r(b)
  WINDOW w AS (PARTITION BY model_id, cat, b ORDER BY sha256(concat_ws('|', '3', b, forecast_id)), forecast_id ROWS UNBOUNDED PRECEDING))
SELECT model_id, category, step, R(quantile_cont(cum, 5e-2)) AS lo, R(quantile_cont(cum, 95e-2)) AS hi FROM p GROUP BY ALL

-- name: attribution
SELECT model_id, category, R(avg(share * lg)) AS mean_contribution, count(*) AS n_markets FROM fx_members GROUP BY ALL

-- name: trade_screen
WITH f AS (SELECT q.condition_id, u.venue, u.category, q.mid, q.spread, q.bid_depth_usd, q.ask_depth_usd,
    least(99e-2, greatest(1e-2, q.mid + (HASH(q.condition_id) % 101 - 50) / 200e0)) AS p
  FROM fx_latest q JOIN fx_universe u ON u.condition_id = q.condition_id WHERE tier = 'liquid' AND q.mid IS NOT NULL
    AND q.condition_id NOT IN (SELECT condition_id FROM fx_trades_book WHERE stake > 400)),
r AS (SELECT f.*, coalesce((SELECT max_by(taker_rate, (CASE WHEN x.category = f.category THEN 100000 ELSE 0 END) + x.effective_day) FROM fx_fees x
    WHERE x.venue = f.venue AND x.effective_day <= 10592 AND (x.category = f.category OR x.category = 'default')), 0e0) AS rate,
    CASE WHEN p > mid THEN 'YES' ELSE 'NO' END AS side, CASE WHEN p > mid THEN ask_depth_usd ELSE bid_depth_usd END AS depth,
    CASE WHEN p > mid THEN mid + spread / 2 ELSE 1 - (mid - spread / 2) END AS raw, CASE WHEN p > mid THEN p ELSE 1 - p END AS p_win FROM f),
s AS (SELECT *, CASE WHEN raw > 0 AND raw < 1 AND (p_win - raw) / (1 - raw) > 0 THEN 10000 * least((p_win - raw) / (1 - raw) * 2e-1, 5e-2) ELSE 0e0 END AS stake FROM r
  WHERE mid > 5e-2 AND mid < 95e-2 AND abs(p - mid) >= 5e-2 AND spread <= 3e-2 AND depth >= 500),
e AS (SELECT *, least(999e-3, raw + least(2e-2, 5e-1 * stake / depth)) AS entry FROM s WHERE stake > 0)
SELECT condition_id, side, R(raw) AS raw_price, R(stake) AS stake, R(entry) AS entry_price, R(rate * (1 - entry) * stake) AS fee, R(abs(p - mid)) AS edge FROM e

-- name: exposure_admit
WITH c AS (SELECT coalesce(m.category, 'unknown') AS category, opened_s AS seq, trade_id, stake FROM fx_trades_book t JOIN fx_markets m ON m.condition_id = t.condition_id),
g AS (SELECT category, list({'used': stake, 'ids': [trade_id]} ORDER BY seq, trade_id) AS items FROM c GROUP BY category),
a AS (SELECT category, unnest(list_reduce(list_prepend({'used': cast(HASH(category) % 1500 AS double), 'ids': cast([] AS varchar[])}, items),
  lambda x, y : CASE WHEN x.used + y.used <= 2000 THEN {'used': x.used + y.used, 'ids': list_concat(x.ids, y.ids)} ELSE x END).ids) AS trade_id FROM g)
SELECT c.category, c.seq, c.trade_id, R(c.stake) AS stake FROM c JOIN a ON a.category = c.category AND a.trade_id = c.trade_id

-- name: trade_settle
SELECT trade_id, exit_s, R(pnl) AS pnl, 'resolved' AS status FROM fx_settled

-- name: trade_summary
WITH path AS (SELECT sum(pnl) OVER w AS cum, row_number() OVER w AS i FROM fx_settled WINDOW w AS (ORDER BY exit_s, trade_id ROWS UNBOUNDED PRECEDING)),
dd AS (SELECT min(cum - greatest(0e0, peak)) AS low FROM (SELECT cum, max(cum) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM path)),
o AS (SELECT count(*) AS n, coalesce(sum(stake / entry_price * CASE WHEN token_side = 'YES' THEN mid ELSE 1 - mid END - stake), 0) AS u
  FROM fx_trades_book t LEFT JOIN fx_latest q ON q.condition_id = t.condition_id WHERE t.condition_id NOT IN (SELECT condition_id FROM fx_resolutions)),
d AS (SELECT count(*) AS n, sum(pnl) AS pnl, sum(fee) AS fees, count(*) FILTER (pnl > 0) AS wins FROM fx_settled)
SELECT d.n AS resolved_trades, R(pnl) AS realized_pnl, R(fees) AS total_fees, R(pnl + fees) AS gross_pnl, R(wins / d.n) AS hit_rate, o.n AS open_trades,
  R(u) AS unrealized_pnl, R(least(0e0, low)) AS max_drawdown FROM d, o, dd
