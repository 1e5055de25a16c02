"""Queries of the scoring base and the estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators import estimators as E
from augurmill.operators import health, scoring, universe
from augurmill.plans.registry import query
from augurmill.sources import fixtures as fx

AS_OF, START = fx.AS_OF, fx.WINDOW_START
SINCE = 883612800        # 1998-01-01
POOL_SINCE = 915148800   # 1999-01-01
EXCLUDED = [(9400, 9420), (9700, 9700), (10100, 10160)]  # days since the epoch
CELL = ["model_id", "venue"]


def scored(spark, sf, **kw):
    return scoring.scored_rows(fx.forecasts(spark, sf), fx.resolutions(spark, sf), None, AS_OF, **kw)


def all_resolved(spark, sf):
    return scored(spark, sf, include_disputed=True, censor=False)


def versions(spark, sf):
    """Two models count as registered halfway through their own record."""
    span = (fx.forecasts(spark, sf).where("model_id in ('m3_evidence', 'm7_crossvenue')")
            .groupBy("model_id").agg(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi")))
    return span.select("model_id", F.expr("lo + (hi - lo) div 2").alias("registered_s"))


def fees(spark, sf):
    n = F.col("n_nationkey")
    return fx.table(spark, sf, "nation").select(
        (8035 + 120 * n).cast("long").alias("effective_day"),
        F.when(n % 4 == 0, "kalshi").when(n % 4 == 3, "metaculus").otherwise("polymarket").alias("venue"),
        F.when(n % 3 == 0, "default").when(n % 3 == 1, "weather").otherwise("politics").alias("category"),
        (n / 400e0).alias("taker_rate"))


def control_ids(spark, sf):
    sports = fx.markets(spark, sf).where("category = 'sports'")
    return universe.bottom_k_sample(sports, 200, 42)


@query
def scored_rows(spark, sf):
    m = fx.markets(spark, sf).select("condition_id", "event_id", "end_s")
    f = fx.forecasts(spark, sf).drop("event_id", "end_s", "venue", "category", "neg_risk")
    return scoring.scored_rows(f, fx.resolutions(spark, sf), m, AS_OF).select(
        "forecast_id", "model_id", "cluster_id", "entry_s", "payout_yes", "p_yes", "p_market_at_ts")


@query
def forward_only(spark, sf):
    return scoring.forward_only(fx.forecasts(spark, sf), versions(spark, sf)).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first_ts_s"))


@query
def exclude_windows(spark, sf):
    return scoring.exclude_windows(fx.forecasts(spark, sf), "kalshi", EXCLUDED).groupBy("venue", "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ts_s").alias("sum_ts_s"))


@query
def horizon_bucket(spark, sf):
    return scoring.horizon_bucket(scored(spark, sf)).groupBy("model_id", "stated_bucket", "realized_bucket").agg(
        F.count(F.lit(1)).alias("n"))


@query
def window_members(spark, sf):
    return scoring.window_members(scored(spark, sf), AS_OF, START).groupBy("model_id", "window_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(X.skill("p_yes", "p_market_at_ts", "payout_yes")).alias("skill"))


@query
def robustness_variants(spark, sf):
    return scoring.robustness_variants(all_resolved(spark, sf), AS_OF, SINCE, POOL_SINCE).groupBy(
        "variant", "model_id").agg(F.count(F.lit(1)).alias("n"),
                                   F.avg(X.skill("p_yes", "p_market_at_ts", "payout_yes")).alias("skill"))


@query
def eval_matrix(spark, sf):
    return scoring.eval_matrix(all_resolved(spark, sf), control_ids(spark, sf), AS_OF, START, SINCE, POOL_SINCE)


@query
def paired_skill(spark, sf):
    return E.paired_skill(scored(spark, sf), CELL)


@query
def bootstrap_ci(spark, sf):
    return E.bootstrap_ci(scored(spark, sf), CELL, seed=7)


@query
def bootstrap_ci_poisson(spark, sf):
    return E.bootstrap_ci_poisson(scored(spark, sf), CELL, seed=7)


@query
def cluster_sequence(spark, sf):
    return E.cluster_sequence(scored(spark, sf), ["model_id"])


@query
def confidence_sequence(spark, sf):
    return E.confidence_sequence(scored(spark, sf), CELL)


@query
def confidence_path(spark, sf):
    return E.confidence_path(scored(spark, sf), ["model_id"])


@query
def stratified_skill(spark, sf):
    return E.stratified_skill(scored(spark, sf), CELL)


@query
def stratified_ci(spark, sf):
    return E.stratified_ci(scored(spark, sf), ["model_id"], seed=11)


@query
def calibration_bins(spark, sf):
    return E.calibration_bins(scored(spark, sf), CELL)


def legs(spark, sf):
    return (fx.markets(spark, sf).where("venue = 'polymarket' and neg_risk = 1 and event_id is not null")
            .withColumn("question", F.concat(F.lit("Will the total exceed $"),
                                             F.format_number(F.floor("liquidity_num"), 0), F.lit("?")))
            .withColumn("order_value", X.first_number("question")))


def leg_rows(spark, sf):
    """Every leg forecast by two models in three passes, a few missing."""
    from pyspark.sql.functions import col as c
    o = fx.markets(spark, sf).where("venue = 'polymarket' and neg_risk = 1 and event_id is not null")
    passes = (o.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(3)])))
              .withColumn("m", F.explode(F.array(F.lit(1), F.lit(4))))
              .withColumn("ts_s", F.lit(AS_OF) - 86400 * (300 + 700 * c("pass")))
              .where((c("first_seen_s") <= c("ts_s")) & ((c("k") + 3 * c("pass")) % 17 != 0)))
    price = 2e-2 + 9e-1 * (((c("k") * 31 + c("pass") * 101) % 997) / 996e0)
    return passes.select(
        F.concat_ws("-", "condition_id", c("pass").cast("string"), c("m").cast("string")).alias("forecast_id"),
        F.when(c("m") == 1, "m1_debiased").otherwise("m4_ensemble").alias("model_id"),
        "event_id", "condition_id", "venue", "ts_s", price.alias("p_market_at_ts"),
        F.least(F.lit(0.99), price * (8e-1 + 1e-1 * ((c("k") + c("m")) % 5))).alias("p_yes"),
        F.when((c("k") * 7 + F.substring("event_id", 2, 12).cast("long")) % 10 == 0, 1.0).otherwise(0.0).alias("payout_yes"))


@query
def bucketed_events(spark, sf):
    return E.bucketed_events(leg_rows(spark, sf), legs(spark, sf), ["model_id"]).groupBy(
        "model_id", "event_id", "ts_s", "verdict").agg(
        F.max("k").alias("k"), F.max("winners").alias("winners"),
        F.abs(F.max("sum_model") - 1).alias("coherence_deviation"))


def rps_rows(spark, sf):
    return E.rps(E.bucketed_events(leg_rows(spark, sf), legs(spark, sf), ["model_id"]), ["model_id"])


@query
def rps(spark, sf):
    return rps_rows(spark, sf)


@query
def rps_skill(spark, sf):
    return E.rps_skill(rps_rows(spark, sf), ["model_id"])


@query
def taker_rate(spark, sf):
    return E.taker_rate(scored(spark, sf), fees(spark, sf)).select("forecast_id", "venue", "category", "taker_rate")


@query
def net_growth(spark, sf):
    return E.net_growth(scored(spark, sf), fees(spark, sf), CELL)


def drift_targets(spark, sf):
    return fx.drift_forecasts(spark, sf).withColumn(
        "model_id", F.when(F.col("forecast_id") % 2 == 0, "m1_debiased").otherwise("m4_ensemble"))


def gaps(spark, sf):
    lo, hi = 1704067200, 1704067200 + 30 * X.DAY
    return health.gap_windows(fx.snapshots(spark, sf), fx.snapshots(spark, sf).select("condition_id").distinct(),
                              15, lo, hi)


@query
def quote_asof(spark, sf):
    t = fx.drift_forecasts(spark, sf).withColumn("target_s", F.col("ts_s") + 24 * X.HOUR)
    return E.quote_asof(t, fx.snapshots(spark, sf)).where("quote_s is not null").select(
        "forecast_id", "condition_id", "target_s", "quote_s", "mid")


@query
def drift(spark, sf):
    return E.drift(drift_targets(spark, sf), fx.snapshots(spark, sf), gaps(spark, sf))


@query
def drift_trust(spark, sf):
    t = fx.drift_forecasts(spark, sf).withColumn("target_s", F.col("ts_s") + 24 * X.HOUR)
    hit = E.quote_asof(t, fx.snapshots(spark, sf)).where("abs(p_yes - p_market_at_ts) >= 1e-9D")
    y = F.when(F.col("forecast_id") * 7 % 10 < 4, 1.0).otherwise(0.0)
    rows = hit.select(
        "condition_id", (F.signum(F.col("p_yes") - F.col("p_market_at_ts")) * (F.col("mid") - F.col("p_market_at_ts"))).alias("drift"),
        X.skill("p_yes", "p_market_at_ts", y).alias("skill"))
    k = F.col("c_custkey")
    markets = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("s"), k).alias("condition_id"), F.lit("kalshi").alias("venue"), F.when(k % 3 == 0, universe.CONTROL_CATEGORY).otherwise("other").alias("category"))
    return E.drift_trust(rows, universe.control_members(t, markets))


def eval_runs(spark, sf):
    """Stored evaluation rows: one per order, with null venues and categories among them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return fx.table(spark, sf, "orders").select(
        k.alias("run_id"), fx.epoch("o_orderdate").alias("ts_s"),
        F.concat(F.lit("m"), k % 7).alias("model_id"),
        F.when(c % 3 == 0, "all_time").when(c % 3 == 1, "trailing_90d").otherwise("confirmatory").alias("window_label"),
        F.when(c % 5 == 0, F.lit(None)).when(c % 5 < 3, "polymarket").otherwise("kalshi").alias("venue"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 11 < 6, "weather").otherwise("ALL").alias("category"),
        (c % 900).alias("n_event_clusters"),
        ((F.col("o_totalprice") % 1000) / 1e4 - 5e-2).alias("skill"),
        (1e-3 + (k % 13) / 1e3).alias("mde"),
        F.when(k % 4 != 0, (c % 40) / 1e2).alias("rps"),
        F.when(k % 3 != 0, (k % 50) / 1e3 - 2e-2).alias("net_growth"))


@query
def eval_latest(spark, sf):
    return E.eval_latest(eval_runs(spark, sf), "kalshi", SINCE)
