"""Queries of the landing jobs and the streams; streams run to the end of the given files, then are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.plans.registry import query
from augurmill.session import scratch_path
from augurmill.sources import archive, landing
from augurmill.sources import fixtures as fx
from augurmill.streaming import jobs


def landed_books(spark, sf):
    """Both book shapes from events; some one-sided, unpriced or broken."""
    e = fx.table(spark, sf, "events")
    k = F.col("event_id")
    p = k % 90 + 4

    def cents(x):
        return F.format_string("%.2f", x / 100e0)

    def level(price, size):
        return F.struct(cents(price).alias("price"), size.cast("string").alias("size"))
    asks = F.when(k % 11 == 0, F.array().cast("array<struct<price:string,size:string>>")).otherwise(F.array(level(p + 3, F.lit(20)), level(p + 2, F.lit(8))))
    plain = F.to_json(F.struct(F.array(level(p - 2, F.lit(5)), level(p, 10 + k % 7), level(p, F.lit(3))).alias("bids"), asks.alias("asks")))
    market = F.struct(
        cents(p).alias("yes_bid_dollars"), F.when(k % 11 != 0, cents(p + 2)).alias("yes_ask_dollars"),
        F.when(k % 17 != 0, cents(p + 1)).alias("last_price_dollars"), (k % 5).cast("string").alias("yes_bid_size_fp"),
        F.when(k % 3 != 0, F.lit("40")).alias("yes_ask_size_fp"), (k % 100).cast("string").alias("open_interest_fp"))
    ladders = F.struct(F.array(F.array(cents(p), F.lit("10")), F.array(cents(p - 1), F.lit("0"))).alias("yes_dollars"),
                       F.array(F.array(cents(98 - p), F.lit("7"))).alias("no_dollars"))
    double = F.to_json(F.struct(market.alias("market"), ladders.alias("orderbook_fp")))
    payload = F.when(F.col("user_id") % 2 == 0, plain).otherwise(double)
    return e.select(
        k.alias("quote_id"), F.concat(F.lit("s"), "user_id").alias("condition_id"), fx.epoch("ts").alias("ts_s"),
        F.when(F.col("user_id") % 2 == 0, "polymarket").otherwise("kalshi").alias("venue"),
        F.when(k % 13 == 0, F.substring(payload, 1, 15)).otherwise(payload).alias("payload"))


@query
def quote_etl(spark, sf):
    q = landing.quote_etl(landed_books(spark, sf))
    return q.groupBy("venue", "condition_id", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("best_bid").alias("best_bid"), F.sum("best_ask").alias("best_ask"), F.sum("mid").alias("mid"),
        F.sum("spread").alias("spread"), F.sum("bid_depth_usd").alias("bid_depth_usd"), F.sum("ask_depth_usd").alias("ask_depth_usd"),
        F.sum(F.size("bids")).alias("bid_levels"), F.sum(F.get("asks", F.lit(0))["price"]).alias("top_ask"))


def landed_markets(spark, sf):
    u = fx.universe(spark, sf)
    k = F.col("k")
    stamp = F.date_format(F.timestamp_seconds("end_s"), "yyyy-MM-dd'T'HH:mm:ss")
    outcomes = F.when(k % 13 == 0, F.lit('["Up","Down"]')).otherwise(F.lit('["Yes","No"]'))
    tokens = F.when(k % 17 == 0, F.lit('["t1"]')).otherwise(F.lit('["t1","t2"]'))
    poly = F.to_json(F.struct(
        F.when(k % 101 != 0, F.col("condition_id")).alias("conditionId"), "slug", "question", F.initcap("category").alias("category"),
        F.concat(stamp, F.lit("Z")).alias("endDate"), outcomes.alias("outcomes"), tokens.alias("clobTokenIds"), (F.col("neg_risk") == 1).alias("negRisk"),
        (F.col("active") == 1).alias("active"), (F.col("closed") == 1).alias("closed"), F.col("liquidity_num").alias("liquidityNum")))
    kal = F.to_json(F.struct(
        F.col("venue_native_id").alias("ticker"), F.col("question").alias("title"), "category",
        F.when(F.col("closed") == 1, "finalized").when(k % 5 == 0, "initialized").when(k % 5 == 1, "determined").otherwise("active").alias("status"),
        F.when(k % 3 != 0, F.concat(stamp, F.lit(".40392Z"))).alias("close_time"), F.concat(stamp, F.lit("+02:00")).alias("expiration_time"),
        F.col("volume_num").alias("volume_fp")))
    man = F.to_json(F.struct(k.cast("string").alias("id"), "slug", "question", (F.col("end_s") * 1000 + 7).alias("closeTime"),
                             (F.col("closed") == 1).alias("isResolved"), F.col("volume_num").alias("volume")))
    return u.select(
        F.when(F.col("venue") == "metaculus", "manifold").otherwise(F.col("venue")).alias("venue"),
        F.when(F.col("venue") == "polymarket", poly).when(F.col("venue") == "kalshi", kal).otherwise(man).alias("payload"))


@query
def market_etl(spark, sf):
    return landing.market_etl(landed_markets(spark, sf)).select(
        "venue", "venue_native_id", "condition_id", "category", "end_s", "token_id_no", "neg_risk", "active", "closed", "volume_num", "is_binary", "reject_reason")


def landed_outcomes(spark, sf):
    m = fx.universe(spark, sf)
    k = F.col("k")
    poly = F.to_json(F.struct(
        F.col("condition_id").alias("conditionId"), (F.col("closed") == 1).alias("closed"),
        F.when(k % 6 == 1, F.lit('["0.5","0.5"]')).when(k % 6 == 2, F.lit('["0","1"]')).otherwise(F.lit('["1","0"]')).alias("outcomePrices"),
        F.when(k % 11 == 0, F.lit('["proposed","disputed"]')).when(k % 11 == 1, F.lit('["disputed","resolved"]')).otherwise(F.lit("[]")).alias("umaResolutionStatuses"),
        F.concat(F.date_format(F.timestamp_seconds("end_s"), "yyyy-MM-dd HH:mm:ss"), F.when(k % 5 == 0, "+00").when(k % 5 == 1, ".320219+00:00:00").otherwise("+05:30")).alias("closedTime")))
    kal = F.to_json(F.struct(F.col("venue_native_id").alias("ticker"), F.when(F.col("closed") == 1, "finalized").otherwise("active").alias("status"),
                             F.when(k % 7 == 0, "scalar").when(k % 2 == 0, F.when(k % 8 == 0, "yes").otherwise("no")).alias("result")))
    meta = F.to_json(F.struct(k.cast("string").alias("id"), F.struct(
        F.when(k % 7 == 0, "ambiguous").when(k % 7 == 1, "Yes ").when(k % 7 == 2, "no").when(k % 7 == 3, "1.0").when(k % 7 == 4, "0.4").alias("resolution")).alias("question")))
    return m.select("k", "venue", F.when(F.col("venue") == "polymarket", poly).when(F.col("venue") == "kalshi", kal).otherwise(meta).alias("payload"))


@query
def payout_etl(spark, sf):
    return landing.payout_etl(landed_outcomes(spark, sf))


def in_batches(spark, sf, name, part, start):
    """The given table in three batches, rows with `part` 0 first: a part's files land, the stream runs until it has read
    them, and the next run goes on from its checkpoint. `start` starts the stream on the landed files."""
    whole, path = fx.table(spark, sf, name), scratch_path(spark, f"landed-{name}")
    for k in range(3):
        whole.where(part == k).write.mode("append").parquet(path)
        start(spark.readStream.schema(whole.schema).parquet(path)).awaitTermination()


def quotes_of(e):
    return e.select(F.col("event_id").alias("quote_id"), F.concat(F.lit("s"), "user_id").alias("condition_id"), fx.epoch("ts").alias("ts_s"),
                    F.least(F.lit(98e-2), 2e-2 + 96e-2 * (F.col("value") / 500e0)).alias("mid"))


def third(spark, sf):
    """Events by thirds of their ids."""
    top = fx.table(spark, sf, "events").agg(F.max("event_id")).first()[0] or 0
    return F.floor(F.col("event_id") * 3 / (top + 1))


@query
def stream_snapshots(spark, sf):
    path, checkpoint = scratch_path(spark, "stream-archive"), scratch_path(spark, "checkpoint")
    in_batches(spark, sf, "events", third(spark, sf), lambda e: jobs.stream_snapshots(quotes_of(e), 5, path, checkpoint))
    return archive.snapshot_read(spark, path, columns=["quote_id", "condition_id", "ts_s", "mid"]).withColumn(
        "quote_id", F.col("quote_id").cast("long"))


@query
def stream_latest(spark, sf):
    path, checkpoint = scratch_path(spark, "stream-latest"), scratch_path(spark, "checkpoint")
    padded = lambda e: quotes_of(e).withColumn("quote_id", F.lpad(F.col("quote_id").cast("string"), 20, "0"))
    in_batches(spark, sf, "events", F.col("event_id") % 3, lambda e: jobs.stream_latest(padded(e), path, checkpoint, 16))
    return jobs.latest(spark, path, 16).read().select("condition_id", "ts_s", "mid")


def quoted_markets(spark, sf):
    """Tiers of the markets that events quote; some markets have none."""
    c = fx.table(spark, sf, "customer")
    tier = F.when(F.col("c_acctbal") >= 5000, "liquid").when(F.col("c_acctbal") >= 0, "tail").otherwise("ignored")
    return c.where("c_custkey % 9 <> 0").select(F.concat(F.lit("s"), "c_custkey").alias("condition_id"), tier.alias("tier"))


@query
def stream_coverage(spark, sf):
    path, checkpoint = scratch_path(spark, "stream-coverage"), scratch_path(spark, "checkpoint")
    in_batches(spark, sf, "events", F.col("event_id") % 3,
               lambda e: jobs.stream_coverage(quotes_of(e), quoted_markets(spark, sf), 15, 3600, path, checkpoint))
    return jobs.coverage(spark, path, 15, 3600)


@query
def stream_resolutions(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    table, wealth, state, checkpoint = (scratch_path(spark, f"stream-{n}") for n in ("outcomes", "wealth", "state", "checkpoint"))
    # each batch joins them by market, so they are placed once and not shuffled again
    forecasts = fx.forecasts(spark, sf).select(
        "forecast_id", "condition_id", "event_id", "category", "model_id", "ts_s", "end_s", "p_yes", "p_market_at_ts").persist()

    def start(orders):
        outcomes = orders.where("o_orderstatus <> 'P'").select(
            F.concat(F.lit("m"), k).alias("condition_id"), (fx.epoch("o_orderdate") + X.DAY * (k % 200 + k % 15 - 5)).alias("resolved_s"),
            F.when((c * 7 + k) % 10 < 4, 1.0).otherwise(0.0).alias("payout_yes"), F.when(k % 37 == 0, 1).otherwise(0).alias("disputed"),
            F.lit(None).cast("long").alias("venue_resolved_s"))
        return jobs.stream_resolutions(outcomes, forecasts, fx.AS_OF, table, wealth, state, checkpoint, 16)

    try:
        in_batches(spark, sf, "orders", k % 3, start)
    finally:
        forecasts.unpersist()
    return jobs.wealth_rows(spark, wealth).select("model_id", "category", "forecast_id", "cum_log_wealth", "n_forecasts")
