"""Queries of the wealth and trade accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators import accounting as ACC
from augurmill.operators import estimators as E
from augurmill.operators import scoring
from augurmill.operators import universe as U
from augurmill.plans import models as PM
from augurmill.plans import scoring as S
from augurmill.plans import universe as PU
from augurmill.plans.registry import query
from augurmill.session import cut
from augurmill.sources import fixtures as fx

EARLIER = 915148800  # 1999-01-01: the first of two ledger runs


@query
def kelly_delta(spark, sf):
    return ACC.kelly_delta(S.scored(spark, sf)).select("forecast_id", "side", "price", "kelly", "log_wealth_delta")


def wealth(spark, sf):
    return ACC.wealth_ledger(S.scored(spark, sf))


@query
def wealth_ledger(spark, sf):
    """Two runs, the second carrying on from the first; together they equal one run."""
    early = scoring.scored_rows(fx.forecasts(spark, sf), fx.resolutions(spark, sf), None, EARLIER)
    first = cut(ACC.wealth_ledger(early))
    second = ACC.wealth_ledger(S.scored(spark, sf), first)
    return first.unionByName(second).select("model_id", "category", "forecast_id", "kelly", "cum_log_wealth", "n_forecasts")


@query
def expert_ranking(spark, sf):
    return ACC.expert_ranking(wealth(spark, sf))


@query
def drawdown(spark, sf):
    return ACC.drawdown(wealth(spark, sf), ["model_id", "category"], ["n_forecasts"], "cum_log_wealth").select(
        "forecast_id", "cum_log_wealth", "peak", "drawdown")


@query
def wealth_bands(spark, sf):
    deltas = ACC.kelly_delta(S.scored(spark, sf)).withColumn("category", F.coalesce("category", F.lit("unknown")))
    return ACC.wealth_bands(deltas, ["model_id", "category"], seed=3)


@query
def attribution(spark, sf):
    return ACC.attribution(fx.forecasts(spark, sf), PM.weights(spark, sf))


def todays_forecasts(spark, sf):
    """One row per priced market: a model that leans away from the price by a hashed amount."""
    q = PU.latest(spark, sf).where("mid is not null")
    m = fx.universe(spark, sf).select("condition_id", "venue", "category", "tier").where("tier = 'liquid'")
    lean = (X.hash_int(F.col("condition_id")) % 101 - 50) / 200e0
    rows = q.join(m, "condition_id").select(
        "condition_id", "venue", "category", F.col("mid").alias("p_market_at_ts"), F.col("spread").alias("spread_at_ts"),
        F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("mid") + lean)).alias("p_yes"), F.lit(fx.NOW).cast("long").alias("ts_s"))
    return E.taker_rate(rows, S.fees(spark, sf))


def books(spark, sf):
    return (PU.latest(spark, sf).withColumn("best_bid", F.col("mid") - F.col("spread") / 2)
            .withColumn("best_ask", F.col("mid") + F.col("spread") / 2))


def trades(spark, sf):
    """A book of paper trades, one per line item."""
    li = fx.table(spark, sf, "lineitem")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        F.concat_ws("-", ok.cast("string"), F.col("l_linenumber").cast("string"), pk.cast("string"), F.col("l_suppkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("trade_id"),
        F.concat(F.lit("m"), ok).alias("condition_id"), fx.epoch("l_shipdate").alias("opened_s"),
        F.when(F.col("l_suppkey") % 2 == 0, "YES").otherwise("NO").alias("token_side"),
        (1e-1 + 8e-1 * ((ok * 31 + pk * 7) % 997) / 996e0).alias("entry_price"), (F.col("l_quantity") * 10).alias("stake"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") * F.col("l_tax")).alias("fee"), F.lit("open").alias("status"))


@query
def trade_screen(spark, sf):
    held = trades(spark, sf).where("stake > 400")
    return ACC.trade_screen(todays_forecasts(spark, sf), books(spark, sf), held).select(
        "condition_id", "side", "raw_price", "stake", "entry_price", "fee", "edge")


def admission(spark, sf):
    m = fx.markets(spark, sf).select("condition_id", F.coalesce("category", F.lit("unknown")).alias("category"))
    c = trades(spark, sf).join(m, "condition_id").select("category", F.col("opened_s").alias("seq"), "trade_id", "stake")
    exposure = m.select("category").distinct().withColumn("exposure", (X.hash_int(F.col("category")) % 1500).cast("double"))
    return c, exposure


@query
def exposure_admit(spark, sf):
    c, exposure = admission(spark, sf)
    return ACC.exposure_admit(c, exposure, fold_rows=4000)


def settled(spark, sf):
    return ACC.trade_settle(trades(spark, sf), fx.resolutions(spark, sf))


@query
def trade_settle(spark, sf):
    return settled(spark, sf).select("trade_id", "exit_s", "pnl", "status")


@query
def trade_summary(spark, sf):
    still = trades(spark, sf).join(fx.resolutions(spark, sf), "condition_id", "left_anti")
    latest = U.latest_quote(fx.market_quotes(spark, sf), fx.NOW - 2 * X.DAY, fx.NOW)
    return ACC.trade_summary(settled(spark, sf), still, latest)
