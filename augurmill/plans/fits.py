"""Queries of the fits, correlations, grids and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators import accounting as ACC
from augurmill.operators import fits as FT
from augurmill.plans import ledger as PL
from augurmill.plans import models as PM
from augurmill.plans import scoring as S
from augurmill.plans.registry import query
from augurmill.session import scratch_path
from augurmill.sources import fixtures as fx
from augurmill.sources import ledger

MEMBERS = ["m0_market", "m1_debiased", "m2_baserate", "m3_evidence", "m5_nowcast", "m7_crossvenue"]


def observed(rows, *also):
    """Resolved price rows with their stated horizon."""
    return (rows.where("model_id = 'm0_market'").select(
        *also, "venue", F.col("p_market_at_ts").alias("p_market"), F.col("payout_yes").alias("outcome"),
        ((F.col("end_s") - F.col("ts_s")) / X.DAY).alias("days_to_resolution")).where("days_to_resolution > 0"))


def observations(spark, sf):
    return observed(S.scored(spark, sf), F.col("forecast_id").alias("obs_id"), "condition_id", "category", "cluster_id", "entry_s")


@query
def fit_recalibration(spark, sf):
    return FT.fit_recalibration(observations(spark, sf))


@query
def fit_hier(spark, sf):
    return FT.fit_hier(observations(spark, sf))


@query
def isotonic_bins(spark, sf):
    return FT.isotonic_bins(observations(spark, sf), PM.curves(spark, sf))


@query
def fit_base_rates(spark, sf):
    training = ledger.training_observations(PL.trades(spark, sf), PL.resolved_markets(spark, sf)).select(
        "condition_id", "category", "outcome", F.col("obs_day").alias("order"))
    live = (fx.resolutions(spark, sf).where("disputed = 0 and resolved_s >= 883612800").join(fx.markets(spark, sf), "condition_id")
            .select("condition_id", "category", F.col("payout_yes").alias("outcome")))
    return FT.fit_base_rates(training, live)


@query
def fit_pool_weights(spark, sf):
    return FT.fit_pool_weights(S.scored(spark, sf))


def correlations(spark, sf):
    return FT.pair_correlation(fx.forecasts(spark, sf), MEMBERS)


@query
def pair_correlation(spark, sf):
    return correlations(spark, sf)


@query
def mean_correlation(spark, sf):
    return FT.mean_correlation(correlations(spark, sf))


@query
def daily_pair_correlation(spark, sf):
    users = fx.table(spark, sf, "events").select("user_id").distinct()
    pairs = users.select(F.concat(F.lit("s"), "user_id").alias("a"), F.concat(F.lit("s"), F.col("user_id") + 1).alias("b"))
    return FT.daily_pair_correlation(fx.snapshots(spark, sf), pairs, 1704067200, 1704067200 + 90 * X.DAY)


def pooled(rows, *also):
    return rows.where("model_id = 'm4_ensemble'").select(
        "forecast_id", F.coalesce("category", F.lit("unknown")).alias("category"), "entry_s", *also,
        F.col("p_yes").alias("p_pooled"), F.col("payout_yes").alias("outcome"))


def pooled_rows(spark, sf):
    return pooled(S.scored(spark, sf), "condition_id", "cluster_id")


@query
def fit_exponent(spark, sf):
    return FT.fit_exponent(pooled_rows(spark, sf), ["category"])


def evidence_runs(spark, sf):
    r = fx.resolutions(spark, sf).where("disputed = 0").select("condition_id", F.col("payout_yes").alias("outcome"), F.col("resolved_s").alias("entry_s"))
    return PM.evidence_states(spark, sf).join(r, "condition_id")


@query
def fit_evidence_params(spark, sf):
    return FT.fit_evidence_params(PM.evidence_items(spark, sf), evidence_runs(spark, sf))


def surprises(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.concat(F.lit("S"), "c_nationkey").alias("series"), F.col("c_custkey").alias("period"),
                                               (F.col("c_acctbal") / 1000e0).alias("nowcast"))
    k = F.col("period")
    actual = c.where(k % 6 != 0).select("series", "period", (F.col("nowcast") + (k * 37 % 101 - 50) / 100e0).alias("actual"))
    return FT.surprise_pairs(c, actual)


@query
def surprise_pairs(spark, sf):
    return surprises(spark, sf)


@query
def fit_surprise_sd(spark, sf):
    return FT.fit_surprise_sd(surprises(spark, sf))


@query
def mwu_weights(spark, sf):
    experts = ACC.ranked(ACC.expert_sums(S.scored(spark, sf)))
    return FT.mwu_weights(experts, correlations(spark, sf))


def replay_rows(spark, sf):
    return FT.pool_replay_rows(S.scored(spark, sf), fx.forecasts(spark, sf))


@query
def pool_replay_rows(spark, sf):
    return replay_rows(spark, sf).select("condition_id", "category", "model_id", "p_yes", "n_members", "outcome", "pool_s")


def curve_versions(spark, sf):
    old = PM.curves(spark, sf).withColumn("version", F.lit("old"))
    return old.unionByName(old.withColumn("version", F.lit("new")).withColumn("alpha", F.lit(-0.4)).withColumn("beta", F.lit(0.1)))


def written(df, name):
    """`df` as a table: read by several joins and jobs it is derived once, and its size is known to them."""
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def weight_versions(spark, sf):
    old = written(PM.weights(spark, sf), "weights").withColumn("version", F.lit("old"))  # a few rows from all forecasts
    return old.unionByName(old.where("category <> 'politics'").withColumn("version", F.lit("new")).withColumn("weight", 0.6 - F.col("weight")))


VERSIONS = ("old", "new")


def replayed(spark, sf):
    a = FT.replay_curves(observations(spark, sf), curve_versions(spark, sf), VERSIONS)
    b = FT.replay_weights(replay_rows(spark, sf), weight_versions(spark, sf), VERSIONS)
    return (a.select(F.lit("m1_curves").alias("model_key"), F.col("obs_id").alias("row_id"), "version", "p", "outcome", "cluster_id", "entry_s")
            .unionByName(b.select(F.lit("m4_weights").alias("model_key"), F.col("condition_id").alias("row_id"), "version", "p", "outcome",
                                  "cluster_id", "entry_s")))


@query
def replay(spark, sf):
    return replayed(spark, sf).select("model_key", "row_id", "version", "p")


@query
def gate(spark, sf):
    diffs = FT.paired_versions(replayed(spark, sf), ["model_key", "row_id"], "old", "new")
    return FT.gate(diffs, ["model_key"])


@query
def rollback_check(spark, sf):
    last = FT.newest(observations(spark, sf), 50, "obs_id")
    rows = FT.replay_curves(last, curve_versions(spark, sf), VERSIONS).withColumn("model_key", F.lit("m1_curves"))
    return FT.rollback_check(FT.paired_versions(rows, ["model_key", "obs_id"], "old", "new"), ["model_key"])



@query
def bounded_steps(spark, sf):
    """All kinds of fits, each held within a fifth of the parameters in use: one row per kind, key and parameter.

    The four fits of forecasts read one table of scored rows, the parameters in use one of the ledger's cells.
    """
    rows = written(S.scored(spark, sf).select("model_id", "category", "venue", "entry_s", "end_s", "ts_s", "p_market_at_ts", "p_yes", "payout_yes",
                                              F.when(F.col("model_id") == "m4_ensemble", F.col("forecast_id")).alias("forecast_id")), "scored")  # ids order pooled rows only
    cells = written(fx.forecasts(spark, sf).select("category", "model_id").distinct(), "cells")
    obs = observed(rows)
    own = PM.offsets(spark, sf).select("bucket", "venue", F.col("alpha_offset").alias("alpha"), F.col("beta_offset").alias("beta"))
    hier_old = PM.curves(spark, sf).select("bucket", F.lit(None).cast("string").alias("venue"), "alpha", "beta").unionByName(own)
    sd_old = surprises(spark, sf).select("series").distinct().withColumn("sd", (1 + F.substring("series", 2, 9).cast("int") % 5) / 10e0)
    kinds = {
        "curves": (FT.fit_recalibration(obs), PM.curves(spark, sf), ["bucket"], ["alpha", "beta"]),
        "hier": (FT.fit_hier(obs), hier_old, ["bucket", "venue"], ["alpha", "beta"]),
        "weights": (FT.fit_pool_weights(rows), PM.weights(spark, sf, cells), ["category", "model_id"], ["weight"]),
        "exponents": (FT.fit_exponent(pooled(rows), ["category"]), PM.exponents(spark, sf, cells), ["category"], ["a"]),
        "surprise_sd": (FT.fit_surprise_sd(surprises(spark, sf)), sd_old, ["series"], ["sd"])}
    out = None
    for kind, (new, old, keys, values) in kinds.items():
        moved = FT.bounded_step(new, old, keys, values)
        name = F.concat_ws("|", *[F.coalesce(F.col(k), F.lit("")) for k in keys]).alias("name")
        long = moved.select(F.lit(kind).alias("kind"), name, F.explode(F.array(*[F.struct(F.lit(v).alias("parameter"), F.col(v).cast("double").alias("value")) for v in values])).alias("p")).select("kind", "name", "p.*")
        out = long if out is None else out.unionByName(long)
    return out
