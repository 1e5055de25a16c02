"""Bulk forecasts: each model is a column expression or one join over the eligible states.

A model is a function (states, params) -> rows with `condition_id` and `p_yes`;
abstaining means the row is absent. `register` lets a user add one, built from
columns or from a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurmill.functions import exprs as X

MODELS: dict[str, Callable[..., DataFrame]] = {}

# Fixed values.
POOLABLE = ("m0_market", "m1_debiased", "m2_baserate", "m3_evidence", "m5_nowcast", "m6_consistency", "m7_crossvenue")
BLEND_WEIGHT = 0.15
DEVIATION_THRESHOLD, LEG_MIN_SHIFT = 0.03, 0.01


def register(model_id: str):
    def wrap(fn):
        MODELS[model_id] = fn
        return fn
    return wrap


def run_models(states: DataFrame, params: dict[str, tuple], models: list[str] | None = None) -> DataFrame:
    """Union of the registered models over one frozen set of states."""
    out = None
    for model_id in models or list(MODELS):
        rows = (MODELS[model_id](states, *params.get(model_id, ()))
                .select("condition_id", F.lit(model_id).alias("model_id"), "p_yes"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("m0_market")
def m0_market(states: DataFrame) -> DataFrame:
    return states.withColumn("p_yes", X.clamp_p("p_market"))


def _with_bucket(states: DataFrame) -> DataFrame:
    return states.withColumn("bucket", X.horizon_bucket("days_to_resolution"))


@register("m1_debiased")
def m1_recalibrated(states: DataFrame, curves: DataFrame) -> DataFrame:
    z = F.col("alpha") + F.col("beta") * X.logit("p_market")
    return (_with_bucket(states).join(curves.select("bucket", "alpha", "beta"), "bucket")
            .withColumn("p_yes", X.clamp_p(X.sigmoid(z))))


def hier_probability(rows: DataFrame, curves: DataFrame, offsets: DataFrame, price: str, how: str = "inner") -> DataFrame:
    """Add `p_hier` from the global curve plus the venue's offset, 0 where it has none."""
    z = (F.col("alpha") + F.coalesce("alpha_offset", F.lit(0.0))
         + (F.col("beta") + F.coalesce("beta_offset", F.lit(0.0))) * X.logit(price))
    return (rows.join(curves.select("bucket", "alpha", "beta"), "bucket", how)
            .join(offsets.select("bucket", "venue", "alpha_offset", "beta_offset"), ["bucket", "venue"], "left")
            .withColumn("p_hier", X.sigmoid(z)).drop("alpha", "beta", "alpha_offset", "beta_offset"))


@register("m1_hier")
def m1_hier_recalibrated(states: DataFrame, curves: DataFrame, offsets: DataFrame) -> DataFrame:
    return (hier_probability(_with_bucket(states), curves, offsets, "p_market")
            .withColumn("p_yes", X.clamp_p("p_hier")).drop("p_hier"))


@register("m2_baserate")
def m2_blended(states: DataFrame, base_rates: DataFrame) -> DataFrame:
    z = (1 - BLEND_WEIGHT) * X.logit("p_market") + BLEND_WEIGHT * X.logit("base_rate")
    return (states.join(base_rates.select("category", "base_rate"), "category")
            .withColumn("p_yes", X.clamp_p(X.sigmoid(z))))


def evidence_delta(k, tau_days) -> Column:
    """One item's shift in log-odds; items without a date or after the forecast give 0."""
    sign = F.when(F.col("direction") == "for_yes", 1.0).when(F.col("direction") == "for_no", -1.0).otherwise(0.0)
    age = (F.col("forecast_s") - F.col("published_s")) / X.DAY

    def grade(c):
        return F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1)).cast("int")))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(0.0))))
    delta = X.lit(k) * grade("strength") * grade("source_reliability") * relevance * sign * F.exp(-age / X.lit(tau_days))
    return F.when(F.col("published_s").isNull() | (age < 0), 0.0).otherwise(delta)


def m3_evidence_score(items: DataFrame, states: DataFrame, k: float = 0.15, tau_days: float = 5.0,
                      max_shift: float = 0.8) -> DataFrame:
    """Sum of item shifts per state, capped both ways. `states` hold (condition_id, forecast_s, p_market)."""
    shifts = (items.join(states.select("condition_id", "forecast_s"), "condition_id")
              .groupBy("condition_id").agg(F.sum(evidence_delta(k, tau_days)).alias("total_shift"),
                                           F.count(F.lit(1)).alias("n_items")))
    clipped = F.least(F.lit(max_shift), F.greatest(F.lit(-max_shift), F.col("total_shift")))
    return (states.join(shifts, "condition_id").withColumn("clipped_shift", clipped)
            .withColumn("p_yes", X.clamp_p(X.sigmoid(X.logit("p_market") + F.col("clipped_shift")))))


def pool_members(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Newest forecast per (market, day, member) with its share of the pool.

    Members missing from a weighted category count 0; a category without
    weights, or with none left, is pooled equally. Fewer than two: no pool.
    """
    key = ["condition_id", "day"]
    latest = (forecasts.where(F.col("model_id").isin(*POOLABLE)).withColumn("day", X.day_of("ts_s"))
              .groupBy(*key, "model_id")
              .agg(F.max_by(F.struct("p_yes", "category"), F.struct("ts_s", "forecast_id")).alias("v"))
              .select(*key, "model_id", "v.*"))
    weighted = weights.select("category").distinct().withColumn("__weighted", F.lit(True))
    raw = (latest.join(weights.select("category", "model_id", "weight"), ["category", "model_id"], "left")
           .join(weighted, "category", "left")
           .withColumn("w", F.when(F.col("__weighted"), F.coalesce("weight", F.lit(0.0))).otherwise(1.0)))
    totals = raw.groupBy(*key).agg(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    share = F.when(F.col("sw") > 0, F.col("w") / F.col("sw")).otherwise(1 / F.col("n"))
    return (raw.join(totals, key).withColumn("share", share).withColumn("logit", X.logit("p_yes"))
            .select(*key, "category", "model_id", "p_yes", "n", "share", "logit"))


def m4_pool(forecasts: DataFrame, weights: DataFrame, exponents: DataFrame) -> DataFrame:
    """Weighted mean of logits per market and day, extremized by the discounted exponent."""
    pooled = pool_members(forecasts, weights).groupBy("condition_id", "day", "category").agg(
        F.max("n").alias("n_members"), F.sum(F.col("share") * F.col("logit")).alias("raw_logit"))
    a = X.discounted_exponent(F.coalesce("a", F.lit(1.0)), "n_members", "rho_bar")
    return (pooled.join(exponents.select("category", "a", "rho_bar"), "category", "left")
            .withColumn("p_yes", X.clamp_p(X.sigmoid(a * F.col("raw_logit"))))
            .select("condition_id", "day", "category", "n_members", "raw_logit", "p_yes"))


def m5_threshold_share(members: DataFrame, specs: DataFrame) -> DataFrame:
    """Share of ensemble members past the threshold, (x+1)/(n+2); five members at least.

    Members come as rows, so a market's ensemble is counted map-side.
    """
    above = F.count(F.when(F.col("member") > F.col("threshold"), 1))
    n = F.count("member")
    joined = members.where("member is not null").join(specs.select("condition_id", "threshold", "above"), "condition_id")
    out = joined.groupBy("condition_id").agg(n.alias("n_members"), above.alias("exceed"), F.first("above").alias("above"))
    hits = F.when(F.col("above") == 1, F.col("exceed")).otherwise(F.col("n_members") - F.col("exceed"))
    return out.where("n_members >= 5").withColumn("p_yes", (hits + 1) / (F.col("n_members") + 2))


def m5_normal_tail(states: DataFrame, nowcasts: DataFrame) -> DataFrame:
    """Chance that the print lies past the threshold, normal around the nowcast."""
    above = 1 - X.normal_cdf((F.col("threshold") - F.col("nowcast")) / F.col("sd"))
    return (states.join(nowcasts.select("series", "nowcast", "sd"), "series")
            .withColumn("p_yes", X.clamp_p(F.when(F.col("above") == 1, above).otherwise(1 - above))))


def m6_coherence(legs: DataFrame) -> DataFrame:
    """`legs`: every open leg of exclusive events with `p` null where it has no fresh price.

    Events with every leg priced get sum and deviation from one aggregate; it
    is joined back, so a large event is not gathered in one window.
    """
    events = legs.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_legs"), F.count("p").alias("n_fresh"), F.sum("p").alias("sum_p"))
    off = events.where((F.col("n_legs") == F.col("n_fresh")) & (F.col("n_legs") >= 2) & (F.col("sum_p") > 0)
                       & (F.abs(F.col("sum_p") - 1) > DEVIATION_THRESHOLD))
    coherent = F.col("p") / F.col("sum_p")
    return (legs.join(off, "event_id").where(F.abs(coherent - F.col("p")) >= LEG_MIN_SHIFT)
            .select("condition_id", "event_id", "n_legs", F.col("p").alias("p_market"),
                    (F.col("sum_p") - 1).alias("deviation"), coherent.alias("p_yes")))


def m6_implication(links: DataFrame, prices: DataFrame) -> DataFrame:
    """P(narrow) may exceed P(broad) by the threshold at most; else both move to the midpoint."""
    n = prices.select(F.col("condition_id").alias("narrow"), F.col("p").alias("p_narrow"))
    b = prices.select(F.col("condition_id").alias("broad"), F.col("p").alias("p_broad"))
    bad = (links.where("kind = 'implies'").join(n, "narrow").join(b, "broad")
           .where(F.col("p_narrow") - F.col("p_broad") > DEVIATION_THRESHOLD))
    side = F.explode(F.array(F.struct(F.col("narrow").alias("condition_id"), F.col("p_narrow").alias("p_market")),
                             F.struct(F.col("broad").alias("condition_id"), F.col("p_broad").alias("p_market"))))
    return bad.select("narrow", "broad", side.alias("s"), ((F.col("p_narrow") + F.col("p_broad")) / 2).alias("p_yes")).select(
        "narrow", "broad", "s.*", "p_yes")


def m7_cross_pool(pairs: DataFrame, own: DataFrame, external: DataFrame, curves: DataFrame, offsets: DataFrame,
                  a: float, rho_bar: float, recalibrated_venue: str = "metaculus") -> DataFrame:
    """Mean logit of external quotes of confirmed pairs; `own` are the markets with a fresh price of their own."""
    quoted = (pairs.join(own.select("condition_id", "days_to_resolution"), "condition_id")
              .join(external.select("venue", "external_id", "price"), ["venue", "external_id"]))
    quoted = hier_probability(_with_bucket(quoted), curves, offsets, "price", "left")
    price = F.when((F.col("venue") == recalibrated_venue) & F.col("p_hier").isNotNull(), F.col("p_hier")).otherwise(F.col("price"))
    usable = quoted.withColumn("q", price).where("q > 0 and q < 1")
    pooled = usable.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_pooled"), F.avg(X.logit("q")).alias("raw_logit"))
    a_eff = X.discounted_exponent(F.lit(a), "n_pooled", F.lit(rho_bar))
    return pooled.withColumn("p_yes", X.clamp_p(X.sigmoid(a_eff * F.col("raw_logit"))))


def pair_state(verdicts: DataFrame) -> DataFrame:
    """Current state per pair. A confirmation stands; otherwise the latest verdict counts."""
    confirmed = F.max((F.col("status") == "confirmed").cast("int"))
    return verdicts.groupBy("condition_id", "venue", "external_id").agg(
        F.when(confirmed == 1, "confirmed").otherwise(F.max_by("status", F.struct("ts_s", "verdict_id"))).alias("status"),
        F.when(confirmed == 1, F.min(F.when(F.col("status") == "confirmed", F.col("ts_s")))).alias("confirmed_s"))
