"""Declared schemas. Files written before a column existed read it as null; nothing is inferred."""

from __future__ import annotations

LEVELS = "array<struct<price:double,size:double>>"

SNAPSHOTS = (
    "quote_id string, ts_s bigint, condition_id string, token_id_yes string, best_bid double, best_ask double, mid double, "
    f"spread double, bid_depth_usd double, ask_depth_usd double, last_trade_price double, bids {LEVELS}, asks {LEVELS}, "
    "open_interest double, venue string, date date, hour int")

FORECASTS = (
    "forecast_id string, ts_s bigint, condition_id string, model_id string, p_yes double, p_market_at_ts double, "
    "spread_at_ts double, inputs_hash string, evidence_run_id bigint, cost_usd double, depth_covariate double, volume_24h double, "
    "trades_24h int, days_to_resolution_at_ts double, date date")

RESOLUTIONS = ("condition_id string, resolved_s bigint, payout_yes double, disputed int, venue_resolved_s bigint")

WEALTH = ("model_id string, category string, condition_id string, event_id string, forecast_id string, entry_s bigint, ts_s bigint, "
          "kelly double, log_wealth_delta double, cum_log_wealth double, n_forecasts bigint")

EXPERTS = "model_id string, category string, cum_log_wealth double, n_forecasts bigint"

COVERAGE = "tier string, bucket_s bigint, n bigint, late bigint, newest_s bigint"
