"""Gaps, freshness, coverage, backlog and the reporting queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurmill.functions import exprs as X


def gap_windows(quotes: DataFrame, tier_markets: DataFrame, cadence_minutes: int,
                start_s: int, end_s: int) -> DataFrame:
    """Cadence buckets of [start, end) with no quote of any market of the tier.

    Quotes collapse to distinct buckets map-side; the bucket list is bounded by
    the span and the cadence.
    """
    step = cadence_minutes * 60
    n = (end_s - start_s) // step
    seen = (quotes.where((F.col("ts_s") >= start_s) & (F.col("ts_s") < start_s + n * step))
            .join(tier_markets.select("condition_id").distinct(), "condition_id", "left_semi")
            .select(F.floor((F.col("ts_s") - start_s) / step).cast("long").alias("id")).distinct())
    return (quotes.sparkSession.range(0, max(n, 0)).join(seen, "id", "left_anti")
            .select((F.col("id") * step + start_s).alias("gap_start_s"),
                    ((F.col("id") + 1) * step + start_s).alias("gap_end_s")))


def overlaps_gap(rows: DataFrame, gaps: DataFrame, start: str, end: str) -> DataFrame:
    """Add `in_gap`: whether (start, end) overlaps a gap, strictly on both sides.

    Equi-join on the day: each day carries its gaps as one array (bounded by
    the cadence), each distinct window visits the days it touches.
    """
    days = F.explode(F.sequence(X.day_of("gap_start_s"), X.day_of(F.col("gap_end_s") - 1)))
    by_day = (gaps.withColumn("day", days).groupBy("day")
              .agg(F.collect_list(F.struct("gap_start_s", "gap_end_s")).alias("gaps")))
    windows = rows.select(F.col(start).alias("w0"), F.col(end).alias("w1")).distinct()
    hit = F.exists("gaps", lambda g: (F.col("w0") < g["gap_end_s"]) & (g["gap_start_s"] < F.col("w1")))
    found = (windows.withColumn("day", F.explode(F.sequence(X.day_of("w0"), X.day_of("w1"))))
             .join(by_day, "day").where(hit).select("w0", "w1").distinct().withColumn("in_gap", F.lit(True)))
    return (rows.join(found, (F.col(start) == F.col("w0")) & (F.col(end) == F.col("w1")), "left")
            .drop("w0", "w1").withColumn("in_gap", F.coalesce("in_gap", F.lit(False))))


def gap_overlap(forecasts: DataFrame, gaps: DataFrame, horizon_h: int) -> DataFrame:
    """Forecasts whose [t, t+h] overlaps a recorded gap."""
    f = forecasts.withColumn("until_s", F.col("ts_s") + horizon_h * X.HOUR)
    return overlaps_gap(f, gaps, "ts_s", "until_s")


def freshness(quotes: DataFrame, markets: DataFrame, cadences: dict[str, int], now_s: int) -> DataFrame:
    """Newest quote age per tier and venue, with bucket gaps of the last day and week per tier."""
    week = quotes.where((F.col("ts_s") >= now_s - 7 * X.DAY) & (F.col("ts_s") <= now_s))
    tracked = markets.where((F.col("active") == 1) & (F.col("closed") == 0)).select("condition_id", "tier", X.venue_of().alias("venue"))
    seen = week.join(tracked, "condition_id")
    newest = seen.groupBy("tier", "venue").agg(F.max("ts_s").alias("newest_s"))
    counts = tracked.groupBy("tier", "venue").agg(F.count(F.lit(1)).alias("tracked"))
    out = counts.join(newest, ["tier", "venue"], "left").withColumn("age_min", (F.lit(now_s) - F.col("newest_s")) / 60)
    step = F.lit(None).cast("int")
    for tier, minutes in cadences.items():
        step = F.when(F.col("tier") == tier, F.lit(minutes * 60)).otherwise(step)
    covered = seen.withColumn("step", step).where("step is not null")

    def gap_count(days: int, name: str) -> DataFrame:
        start = now_s - days * X.DAY
        hit = covered.where((F.col("ts_s") >= start) & (F.col("ts_s") < now_s)).select(
            "tier", "step", F.floor((F.col("ts_s") - start) / F.col("step")).alias("b")).distinct()
        return hit.groupBy("tier").agg((F.floor(F.lit(days * X.DAY) / F.max("step")) - F.count(F.lit(1))).alias(name))

    return (out.join(gap_count(1, "gaps_24h"), "tier", "left").join(gap_count(7, "gaps_7d"), "tier", "left"))


EVENT_DRIVEN = ("m6_consistency",)


def coverage_drop(forecasts: DataFrame, target_day: int, lookback: int = 14, min_baseline: int = 20, ratio: float = 0.5) -> DataFrame:
    """(model, venue) series whose target day fell below half its own trailing median.

    A missing target day counts 0. The median is over at most `lookback` daily counts.
    """
    day = X.day_of("ts_s")
    daily = (forecasts.where((day > target_day - lookback - 1) & (day <= target_day) & ~F.col("model_id").isin(*EVENT_DRIVEN))
             .groupBy("model_id", X.venue_of().alias("venue"), day.alias("day")).agg(F.count(F.lit(1)).alias("n")))
    series = daily.groupBy("model_id", "venue").agg(
        F.expr(f"percentile(case when day < {target_day} then n end, 0.5D)").alias("baseline"),
        F.count(F.when(F.col("day") < target_day, 1)).alias("n_prior"),
        F.coalesce(F.max(F.when(F.col("day") == target_day, F.col("n"))), F.lit(0)).alias("n"))
    return (series.where((F.col("n_prior") >= 3) & (F.col("baseline") >= min_baseline) & (F.col("n") < ratio * F.col("baseline")))
            .withColumn("ratio", F.col("n") / F.col("baseline")).withColumn("day", F.lit(target_day).cast("long")))


def watch_backlog(markets: DataFrame, resolutions: DataFrame, now_s: int) -> DataFrame:
    """Per venue: markets waiting for an outcome, never checked, oldest check age, open past end."""
    known = resolutions.select("condition_id").distinct().withColumn("__done", F.lit(True))
    m = markets.join(known, "condition_id", "left")
    waiting = F.col("__done").isNull() & ((F.col("closed") == 1) | (F.col("end_s") < now_s))
    past = (F.col("active") == 1) & (F.col("closed") == 0) & (F.col("end_s") < now_s)
    return m.groupBy(X.venue_of().alias("venue")).agg(
        F.count(F.when(waiting, 1)).alias("backlog"),
        F.count(F.when(waiting & F.col("checked_s").isNull(), 1)).alias("never_checked"),
        ((F.lit(now_s) - F.min(F.when(waiting, F.col("checked_s")))) / X.HOUR).alias("oldest_check_age_h"),
        F.count(F.when(past, 1)).alias("active_past_end"))


def counts_by_tier(markets: DataFrame) -> DataFrame:
    return markets.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def venue_counts(markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    known = resolutions.select("condition_id").distinct().withColumn("__done", F.lit(True))
    done = F.col("__done").isNotNull()
    return markets.join(known, "condition_id", "left").groupBy(X.venue_of().alias("venue")).agg(
        F.count(F.lit(1)).alias("markets"), F.count(F.when(done, 1)).alias("resolutions"),
        F.count(F.when((F.col("closed") == 1) & ~done, 1)).alias("closed_unresolved"))


def spend_by_day(spend: DataFrame, cap: float) -> DataFrame:
    """Cost per day and purpose, the day's total, and whether it reached the cap.

    Compared in millionths of a dollar, so the order of summing cannot decide it.
    """
    by_purpose = spend.groupBy(X.day_of("ts_s").alias("day"), "purpose").agg(F.sum("cost_usd").alias("cost_usd"))
    totals = by_purpose.groupBy("day").agg(F.sum("cost_usd").alias("day_usd"))
    return by_purpose.join(totals, "day").withColumn("over_cap", (F.round("day_usd", 6) >= cap).cast("int"))


def exclusions_by_day(log: DataFrame, since_s: int) -> DataFrame:
    return log.where(F.col("ts_s") >= since_s).groupBy(X.day_of("ts_s").alias("day"), "reason").agg(F.count(F.lit(1)).alias("n"))


def inclusions_by_day(markets: DataFrame, since_s: int) -> DataFrame:
    return (markets.where((F.col("first_seen_s") >= since_s) & F.col("tier").isin("liquid", "tail"))
            .groupBy(X.day_of("first_seen_s").alias("day"), "tier").agg(F.count(F.lit(1)).alias("n")))


def skill_table(latest_runs: DataFrame) -> DataFrame:
    """Latest evaluation rows with their data-sufficiency label."""
    return latest_runs.withColumn("label", X.sufficiency("n_event_clusters"))


def top_disagreements(latest_forecasts: DataFrame, model_id: str, n: int = 20) -> DataFrame:
    gap = F.col("p_yes") - F.col("p_market_at_ts")
    return (latest_forecasts.where(F.col("model_id") == model_id).withColumn("disagreement", gap)
            .orderBy(F.abs("disagreement").desc(), "forecast_id").limit(n))


def extremes(scored: DataFrame, existing: DataFrame, since_s: int, decile: float = 0.10) -> DataFrame:
    """Worst and best max(1, int(n * decile)) rows by paired difference, those already written up left out.

    The positions come from distributed prefix counts, since k grows with n.
    """
    from augurmill.functions.prefix import running
    rows = (scored.where((F.col("ts_s") >= since_s) & (F.col("model_id") != "m0_market"))
            .withColumn("diff", X.skill("p_yes", "p_market_at_ts", "payout_yes")))
    placed = running(rows, [], ["diff", "forecast_id"], count="pos").crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") * decile))
    kinds = F.array_compact(F.array(F.when(F.col("pos") <= k, "miss"), F.when(F.col("pos") > F.col("total") - k, "win")))
    return (placed.withColumn("kind", F.explode(kinds))
            .join(existing.select("condition_id", "model_id", "kind"), ["condition_id", "model_id", "kind"], "left_anti")
            .select("kind", "forecast_id", "condition_id", "model_id", "diff"))
