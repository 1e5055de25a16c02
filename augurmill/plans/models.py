"""Queries of the bulk forecast models."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators import models as M
from augurmill.operators import universe as U
from augurmill.plans import universe as PU
from augurmill.plans.registry import query
from augurmill.sources import fixtures as fx

NOW = fx.NOW
BUCKETS = ("lt7d", "7to30d", "30to90d", "gt90d")
VENUES = ("kalshi", "metaculus", "polymarket")


def pick(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def states(spark, sf):
    return U.eligible_states(fx.universe(spark, sf), fx.market_quotes(spark, sf), PU.sample(spark, sf), NOW).withColumnRenamed(
        "mid", "p_market")


def curves(spark, sf):
    r = F.col("r_regionkey")
    return fx.table(spark, sf, "region").where(r <= 2).select(
        pick(BUCKETS, r).alias("bucket"), ((r - 2) / 20e0).alias("alpha"), (9e-1 + r / 20e0).alias("beta"))


def offsets(spark, sf):
    n = fx.table(spark, sf, "nation").groupBy(
        (F.col("n_nationkey") % 4).alias("b"), F.expr("n_nationkey div 4 % 3").alias("v")).agg(F.min("n_nationkey").alias("k"))
    return n.where((F.col("b") + F.col("v")) % 4 != 3).select(
        pick(BUCKETS, F.col("b")).alias("bucket"), pick(VENUES, F.col("v")).alias("venue"),
        (F.col("k") / 50e0).alias("alpha_offset"), (F.col("k") / 100e0 - 1e-1).alias("beta_offset"))


def base_rates(spark, sf):
    return (fx.resolutions(spark, sf).join(fx.markets(spark, sf), "condition_id")
            .where("category is not null and category <> 'sports'")
            .groupBy("category").agg(F.avg("payout_yes").alias("base_rate")))


def weights(spark, sf, cells=None):
    """Of the categories and models in `cells`, or in the ledger."""
    f = (fx.forecasts(spark, sf) if cells is None else cells).where("category in ('economics', 'weather', 'politics')").select("category", "model_id").distinct()
    return f.withColumn("weight", X.hash_int(F.concat_ws("|", "category", "model_id")) % 5 / 10e0)


def exponents(spark, sf, cells=None):
    f = (fx.forecasts(spark, sf) if cells is None else cells).where("category in ('economics', 'sports')").select("category").distinct()
    return f.select("category", (1 + X.hash_int(F.col("category")) % 7 / 4e0).alias("a"),
                    (X.hash_int(F.concat(F.lit("r"), "category")) % 10 / 10e0).alias("rho_bar"))


@query
def m1_recalibrated(spark, sf):
    return M.m1_recalibrated(states(spark, sf), curves(spark, sf)).select("condition_id", "bucket", "p_market", "p_yes")


@query
def m1_hier_recalibrated(spark, sf):
    return M.m1_hier_recalibrated(states(spark, sf), curves(spark, sf), offsets(spark, sf)).select(
        "condition_id", "venue", "bucket", "p_yes")


@query
def m2_blended(spark, sf):
    return M.m2_blended(states(spark, sf), base_rates(spark, sf)).select("condition_id", "category", "p_yes")


def evidence_items(spark, sf):
    """One item per line item; the market's forecast was made 30 days before its end."""
    li = fx.table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("m"), "l_orderkey").alias("condition_id"),
        F.when(F.col("l_returnflag") == "A", "for_yes").when(F.col("l_returnflag") == "N", "for_no").otherwise("neutral").alias("direction"),
        (1 + F.col("l_linenumber") % 3).alias("strength"), (1 + F.col("l_suppkey") % 3).alias("source_reliability"),
        (F.col("l_discount") * 10).alias("relevance"),
        F.when(F.col("l_partkey") % 9 != 0, fx.epoch("l_shipdate")).alias("published_s"))


def evidence_states(spark, sf):
    m = fx.markets(spark, sf)
    return m.select("condition_id", (F.col("end_s") - 30 * X.DAY).alias("forecast_s"),
                    (3e-2 + 94e-2 * ((F.col("k") * 31 % 997) / 996e0)).alias("p_market"))


@query
def m3_evidence_score(spark, sf):
    return M.m3_evidence_score(evidence_items(spark, sf), evidence_states(spark, sf)).select(
        "condition_id", "n_items", "total_shift", "clipped_shift", "p_yes")


@query
def m4_pool(spark, sf):
    return M.m4_pool(fx.forecasts(spark, sf), weights(spark, sf), exponents(spark, sf))


@query
def m5_threshold_share(spark, sf):
    members = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), "l_orderkey").alias("condition_id"), F.col("l_quantity").alias("member"))
    specs = fx.markets(spark, sf).select("condition_id", (10 + F.col("k") % 30).cast("double").alias("threshold"),
                                         (F.col("k") % 2).cast("int").alias("above"))
    return M.m5_threshold_share(members, specs).select("condition_id", "n_members", "p_yes")


@query
def m5_normal_tail(spark, sf):
    c = fx.table(spark, sf, "customer")
    s = c.select(F.concat(F.lit("q"), "c_custkey").alias("condition_id"), (F.col("c_acctbal") / 2000e0).alias("threshold"),
                 (F.col("c_custkey") % 2).cast("int").alias("above"), F.concat(F.lit("S"), F.col("c_nationkey")).alias("series"))
    now = fx.table(spark, sf, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("series"),
                                               (1 + F.col("n_nationkey") / 10e0).alias("nowcast"),
                                               (3e-1 + F.col("n_regionkey") / 10e0).alias("sd"))
    return M.m5_normal_tail(s, now).select("condition_id", "p_yes")


def fresh_prices(spark, sf):
    """Newest mid of each market where it is young enough for the market's tier."""
    q = U.latest_quote(fx.market_quotes(spark, sf), NOW - 2 * X.DAY, NOW).where("mid is not null")
    m = fx.universe(spark, sf).select("condition_id", "tier")
    limit = F.when(F.col("tier") == "liquid", 15).otherwise(90)
    return q.join(m, "condition_id").where((NOW - F.col("ts_s")) / 60 <= limit).select("condition_id", F.col("mid").alias("p"))


@query
def m6_coherence(spark, sf):
    open_legs = fx.universe(spark, sf).where("event_id is not null and venue = 'polymarket' and active = 1 and closed = 0")
    legs = open_legs.select("condition_id", "event_id").join(fresh_prices(spark, sf), "condition_id", "left")
    return M.m6_coherence(legs)


@query
def m6_implication(spark, sf):
    links = fx.markets(spark, sf).select(F.concat(F.lit("m"), "k").alias("narrow"), F.concat(F.lit("m"), F.col("k") + 1).alias("broad"),
                                         F.when(F.col("k") % 5 == 0, "excludes").otherwise("implies").alias("kind"))
    return M.m6_implication(links, fresh_prices(spark, sf))


def external_pairs(spark, sf):
    m = fx.markets(spark, sf).select("condition_id", "k")
    two = m.withColumn("venue", F.explode(F.array(F.lit("kalshi"), F.lit("metaculus"))))
    price = F.when(F.col("venue") == "kalshi", (F.col("k") * 17 % 101) / 100e0).otherwise((F.col("k") * 29 % 97) / 96e0)
    return two.withColumn("external_id", F.concat_ws(":", "venue", F.col("k").cast("string"))).withColumn("price", price)


@query
def m7_cross_pool(spark, sf):
    p = external_pairs(spark, sf)
    return M.m7_cross_pool(p.select("condition_id", "venue", "external_id"), states(spark, sf).select("condition_id", "days_to_resolution"),
                           p.select("venue", "external_id", "price"), curves(spark, sf), offsets(spark, sf), 1.5, 0.4)


@query
def pair_state(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    verdicts = li.select(
        F.concat(F.lit("m"), "l_orderkey").alias("condition_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "kalshi").otherwise("metaculus").alias("venue"),
        F.concat(F.lit("x"), F.col("l_orderkey") % 50).alias("external_id"),
        F.when(F.col("l_partkey") % 7 == 0, "confirmed").when(F.col("l_partkey") % 3 == 0, "rejected").otherwise("proposed").alias("status"),
        fx.epoch("l_shipdate").alias("ts_s"),
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("verdict_id"))
    return M.pair_state(verdicts)
