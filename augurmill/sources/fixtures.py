"""The five ledger-shaped views derived from the driver tables.

Instants are epoch seconds. Everything is a projection or one equi-join, so
column pruning and filters reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 978307200          # 2001-01-01 00:00:00 UTC
WINDOW_START = 852076800   # 1997-01-01 00:00:00 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(name: str):
    return F.unix_seconds(F.col(name).cast("timestamp"))


def markets(spark: SparkSession, sf: str) -> DataFrame:
    return markets_from(table(spark, sf, "orders"))


def markets_from(o: DataFrame, *extra) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    placed = epoch("o_orderdate")
    return o.select(
        F.concat(F.lit("m"), k).alias("condition_id"),
        k.alias("k"),
        F.when(c % 3 != 0, F.concat(F.lit("e"), c)).alias("event_id"),
        F.when(k % 4 == 0, F.lit("kalshi")).when(k % 4 == 3, F.lit("metaculus"))
        .otherwise(F.lit("polymarket")).alias("venue"),
        F.when(k % 50 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "1-URGENT", "economics")
        .when(F.col("o_orderpriority") == "2-HIGH", "weather")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "politics")
        .when(F.col("o_orderpriority") == "5-LOW", "entertainment")
        .otherwise("sports").alias("category"),
        F.when(F.col("o_totalprice") >= 250000, "liquid")
        .when(F.col("o_totalprice") >= 20000, "tail").otherwise("ignored").alias("tier"),
        F.when((k % 4).isin(1, 2) & (c % 3 == 1), 1).otherwise(0).alias("neg_risk"),
        F.col("o_totalprice").alias("liquidity_num"),
        placed.alias("first_seen_s"),
        (placed + 86400 * (k % 200)).alias("end_s"),
        *extra,
    )


def resolutions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.concat(F.lit("m"), k).alias("condition_id"),
        (epoch("o_orderdate") + 86400 * (k % 200 + k % 15 - 5)).alias("resolved_s"),
        F.when((c * 7 + k) % 10 < 4, 1.0).otherwise(0.0).alias("payout_yes"),
        F.when(k % 37 == 0, 1).otherwise(0).alias("disputed"),
    )


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger rows with the market columns frozen beside them.

    They are joined by the market's own id, so a later join or grouping by that id finds the rows in their place.
    """
    li = table(spark, sf, "lineitem")
    m = markets(spark, sf).select("condition_id", "event_id", "venue", "category", "neg_risk", "end_s")
    lk, lp = F.col("l_orderkey"), F.col("l_partkey")
    price = 3e-2 + 94e-2 * (((lk * 31 + (lp % 3) * 101) % 997) / 996e0)
    return li.join(m, F.concat(F.lit("m"), lk) == F.col("condition_id")).select(
        F.concat_ws("-", lk.cast("string"), F.col("l_linenumber").cast("string"), lp.cast("string"),
                    F.col("l_suppkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("forecast_id"),
        "condition_id", "event_id", "venue", "category", "neg_risk", "end_s",
        F.when(F.col("l_linenumber") == 1, "m0_market").when(F.col("l_linenumber") == 2, "m1_debiased")
        .when(F.col("l_linenumber") == 3, "m2_baserate").when(F.col("l_linenumber") == 4, "m3_evidence")
        .when(F.col("l_linenumber") == 5, "m4_ensemble").when(F.col("l_linenumber") == 6, "m5_nowcast")
        .otherwise("m7_crossvenue").alias("model_id"),
        (F.col("end_s") - 86400 * (1 + (lk * 13 + (lp % 3) * 17) % 120)).alias("ts_s"),
        price.alias("p_market_at_ts"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), price + (F.col("l_discount") - 5e-2) * 3e0)).alias("p_yes"),
        (F.col("l_tax") / 4e0).alias("spread_at_ts"),
    )


def quotes_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes as landed: floored to five minutes, duplicates still in."""
    e = table(spark, sf, "events")
    ts = epoch("ts")
    return e.select(
        F.col("event_id").alias("quote_id"),
        F.concat(F.lit("s"), F.col("user_id")).alias("condition_id"),
        (ts - ts % 300).alias("ts_s"),
        F.least(F.lit(98e-2), 2e-2 + 96e-2 * (F.col("value") / 500e0)).alias("mid"),
        "props",
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """The archive: first quote per (market, bucket)."""
    from augurmill.sources.archive import snapshot_dedup
    return snapshot_dedup(quotes_raw(spark, sf))


def drift_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return priced(table(spark, sf, "events").where("event_type = 'purchase'"))


def priced(e: DataFrame) -> DataFrame:
    """Events as forecasts with a price beside them."""
    price = F.least(F.lit(98e-2), 2e-2 + 96e-2 * (F.col("value") / 500e0))
    return e.select(
        F.col("event_id").alias("forecast_id"),
        F.concat(F.lit("s"), F.col("user_id")).alias("condition_id"),
        epoch("ts").alias("ts_s"),
        price.alias("p_market_at_ts"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), price + ((F.col("event_id") % 21) - 10) * 1e-2)).alias("p_yes"),
    )


NOW = 915148800 + 20 * 3600  # 1999-01-01 20:00:00 UTC: the pass instant of the universe queries


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """Markets with the columns a venue sync fills in."""
    done = F.col("o_orderstatus") == "F"
    m = markets_from(table(spark, sf, "orders"), F.when(done, 1).otherwise(0).alias("closed"),
                     F.when(done, 0).otherwise(1).alias("active"))
    return m.select(
        "*",
        F.concat_ws("-", F.concat(F.lit("SER"), F.col("k") % 97), F.expr("k div 97 % 31").cast("string"),
                    F.col("k").cast("string")).alias("venue_native_id"),
        F.concat(F.lit("q-"), "k").alias("slug"),
        F.when(F.col("k") % 40 == 0, F.concat(F.lit("Will Bitcoin trade above $"), "k", F.lit("?")))
        .when(F.col("k") % 40 == 1, F.concat(F.lit("Market cap of firm "), "k", F.lit(" above $2,000?")))
        .otherwise(F.concat(F.lit("Will the count exceed "), "k", F.lit("?"))).alias("question"),
        F.col("first_seen_s").alias("start_s"),
        F.when(F.col("k") % 31 == 0, 3).otherwise(2).alias("n_outcomes"),
        F.when(F.col("k") % 29 == 0, 0).otherwise(1).alias("order_book"),
        (F.col("liquidity_num") * (1 + F.col("k") % 20)).alias("volume_num"),
        (F.col("liquidity_num") % 5000).alias("volume_24h_num"),
        (F.col("k") % 300).cast("double").alias("open_interest"),
        F.when(F.col("k") % 7 != 0, F.lit(NOW) - 3600 * (F.col("k") % 500)).alias("checked_s"),
        (F.lit(NOW) - 3600 * (F.col("k") % 48)).alias("last_synced_s"))


def market_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of the order-shaped markets, within 200 minutes before NOW; one per line item."""
    li = table(spark, sf, "lineitem")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        F.concat_ws("-", ok.cast("string"), F.col("l_linenumber").cast("string"), pk.cast("string"),
                    F.col("l_suppkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("quote_id"),
        F.concat(F.lit("m"), ok).alias("condition_id"),
        (F.lit(NOW) - 60 * (pk % 200)).alias("ts_s"),
        F.when(F.col("l_suppkey") % 23 != 0, 1e-2 + 98e-2 * (((ok * 31 + pk * 7) % 997) / 996e0)).alias("mid"),
        (F.col("l_tax") / 2e0).alias("spread"),
        F.when(pk % 7 != 0, F.col("l_quantity") * 10e0).alias("bid_depth_usd"),
        F.when(pk % 5 != 0, F.col("l_quantity") * (pk % 30)).alias("ask_depth_usd"))


def moves(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "lineitem").groupBy(F.concat(F.lit("m"), "l_orderkey").alias("condition_id"))
            .agg((F.max("l_discount") * 4 - 2e-1).alias("move")))
