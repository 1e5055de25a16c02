"""Queries of health and reporting."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.operators import health as H
from augurmill.plans import scoring as S
from augurmill.plans import text as PT
from augurmill.plans.registry import query
from augurmill.sources import fixtures as fx

NOW = fx.NOW


@query
def gap_windows(spark, sf):
    return S.gaps(spark, sf)


@query
def gap_overlap(spark, sf):
    return H.gap_overlap(fx.drift_forecasts(spark, sf), S.gaps(spark, sf), 1).select("forecast_id", F.col("in_gap").cast("int").alias("in_gap"))


@query
def freshness(spark, sf):
    return H.freshness(fx.market_quotes(spark, sf), fx.universe(spark, sf), {"liquid": 5, "tail": 60}, NOW)


@query
def coverage_drop(spark, sf):
    return H.coverage_drop(fx.forecasts(spark, sf), 10600, min_baseline=1)


@query
def watch_backlog(spark, sf):
    return H.watch_backlog(fx.universe(spark, sf), fx.resolutions(spark, sf), NOW)


@query
def counts_by_tier(spark, sf):
    return H.counts_by_tier(fx.universe(spark, sf))


@query
def venue_counts(spark, sf):
    return H.venue_counts(fx.universe(spark, sf), fx.resolutions(spark, sf))


@query
def spend_by_day(spark, sf):
    spend = fx.table(spark, sf, "lineitem").select(fx.epoch("l_shipdate").alias("ts_s"), F.concat(F.lit("purpose_"), "l_returnflag").alias("purpose"),
                                                   F.col("l_discount").alias("cost_usd"))
    return H.spend_by_day(spend, 1.5)


@query
def exclusions_by_day(spark, sf):
    from augurmill.plans import universe as PU
    return H.exclusions_by_day(PU.exclusion_log(spark, sf), 883612800)


@query
def inclusions_by_day(spark, sf):
    return H.inclusions_by_day(fx.universe(spark, sf), 883612800)


@query
def skill_table(spark, sf):
    return H.skill_table(S.eval_latest(spark, sf))


@query
def top_disagreements(spark, sf):
    f = fx.forecasts(spark, sf)
    newest = f.groupBy("condition_id", "model_id").agg(F.max("ts_s").alias("ts_s"))
    latest = f.join(newest, ["condition_id", "model_id", "ts_s"], "left_semi")
    return H.top_disagreements(latest, "m4_ensemble").select("forecast_id", "condition_id", "p_yes", "p_market_at_ts", "disagreement")


@query
def extremes(spark, sf):
    existing = PT.postmortems(spark, sf).select(
        F.concat(F.lit("m"), "postmortem_id").alias("condition_id"), F.lit("m2_baserate").alias("model_id"), F.lit("miss").alias("kind"))
    return H.extremes(S.scored(spark, sf), existing, 852076800)
