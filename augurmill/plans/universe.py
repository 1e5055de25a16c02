"""Queries of the universe, eligibility and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.operators import universe as U
from augurmill.plans.registry import query
from augurmill.sources import fixtures as fx

NOW = fx.NOW
MODELS = ["m0_market", "m1_debiased", "m2_baserate", "m3_evidence", "m4_ensemble", "m5_nowcast", "m7_crossvenue"]


def latest(spark, sf):
    return U.latest_quote(fx.market_quotes(spark, sf), NOW - 2 * 86400, NOW)


def sample(spark, sf):
    m = U.open_markets(fx.universe(spark, sf)).where(F.col("category") == U.CONTROL_CATEGORY)
    return U.bottom_k_sample(m, 100, 42)


@query
def tier_assign(spark, sf):
    return U.tier_assign(fx.universe(spark, sf), latest(spark, sf)).select("condition_id", "tier", "reason", "depth_usd")


@query
def exclusion_flags(spark, sf):
    return U.exclusion_flags(fx.universe(spark, sf), latest(spark, sf), NOW).select(
        "condition_id", F.array_join("reasons", ",").alias("reasons"))


@query
def exclusion_log(spark, sf):
    flags = U.exclusion_flags(fx.universe(spark, sf), latest(spark, sf), NOW)
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), (fx.epoch("l_shipdate") + 3600 * F.col("l_linenumber")).alias("ts_s"))
    raw = (flags.select("k", "venue", F.col("condition_id").alias("venue_native_id"),
                        F.explode("reasons").alias("reason")).join(li, "k"))
    return U.exclusion_log(raw)


def tagged(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("condition_id"),
                    F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_brand"))).alias("tags"))


def taxonomy(spark, sf):
    from augurmill.functions.exprs import hash_int
    tags = tagged(spark, sf).select(F.explode("tags").alias("raw_tag")).distinct()
    h = hash_int(F.col("raw_tag"))
    return tags.where(h % 3 == 0).select("raw_tag", (h % 5).alias("priority"),
                                         F.concat(F.lit("c"), h % 5).alias("category"))


@query
def category_map(spark, sf):
    return U.category_map(tagged(spark, sf), taxonomy(spark, sf))


@query
def category_drift(spark, sf):
    return U.category_drift(tagged(spark, sf), taxonomy(spark, sf))


@query
def event_from_key(spark, sf):
    return U.event_from_key(fx.universe(spark, sf)).select("condition_id", "event_id")


@query
def event_link(spark, sf):
    """Orders hang on customers, customers on groups of ten; some orders already carry an event."""
    o = fx.table(spark, sf, "orders")
    c = fx.table(spark, sf, "customer")
    edges = o.select(F.concat(F.lit("m"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("b")).unionByName(
        c.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("g"), F.expr("c_custkey div 10")).alias("b")))
    known = o.select(F.concat(F.lit("m"), "o_orderkey").alias("condition_id"),
                     F.when(F.expr("o_custkey div 10 % 2 = 0"), F.concat(F.lit("old"), "o_custkey")).alias("event_id"))
    return U.event_link(edges, known)


@query
def eligible_states(spark, sf):
    return U.eligible_states(fx.universe(spark, sf), fx.market_quotes(spark, sf), sample(spark, sf), NOW).select(
        "condition_id", "venue", "tier", "category", F.col("mid").alias("p_market"), "spread", "quote_s",
        "days_to_resolution", "depth_usd")


@query
def eligibility_rejects(spark, sf):
    return U.eligibility_rejects(fx.universe(spark, sf), fx.market_quotes(spark, sf), sample(spark, sf), NOW)


@query
def due_filter(spark, sf):
    states = U.eligible_states(fx.universe(spark, sf), fx.market_quotes(spark, sf), sample(spark, sf), NOW)
    return U.due_filter(states.select("condition_id"), MODELS, fx.forecasts(spark, sf), fx.moves(spark, sf), NOW).select(
        "condition_id", "model_id", "last_s")


@query
def price_move_24h(spark, sf):
    return U.price_move_24h(fx.snapshots(spark, sf), 1704067200 + 15 * 86400 + 43200)


@query
def bottom_k_sample(spark, sf):
    return U.bottom_k_sample(fx.markets(spark, sf), 150, 42)


@query
def sample_guard(spark, sf):
    m = fx.universe(spark, sf)
    return U.sample_guard(m.select("condition_id", "category"), m, sample(spark, sf)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min("condition_id").alias("first_id"))


@query
def control_members(spark, sf):
    return U.control_members(fx.forecasts(spark, sf), fx.markets(spark, sf))


@query
def rank_candidates(spark, sf):
    return U.rank_candidates(fx.universe(spark, sf), latest(spark, sf), 120)


@query
def boundary_randomize(spark, sf):
    return U.boundary_randomize(U.rank_candidates(fx.universe(spark, sf), latest(spark, sf), 130), 120, 10, "43")


@query
def topic_candidates(spark, sf):
    return U.topic_candidates(fx.universe(spark, sf), 40)


@query
def watch_candidates(spark, sf):
    return U.watch_candidates(fx.universe(spark, sf), fx.resolutions(spark, sf), "polymarket", NOW, 1000)
