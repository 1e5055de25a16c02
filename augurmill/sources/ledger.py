"""Validated appends, latest-wins upserts, training build, exports, increments, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators.audit import day_digests
from augurmill.schemas import FORECASTS

REQUIRED = ("forecast_id", "ts_s", "condition_id", "model_id", "p_yes", "p_market_at_ts")
COVARIATES = {"spread_at_ts": "double", "evidence_run_id": "bigint", "cost_usd": "double", "depth_covariate": "double",
              "volume_24h": "double", "trades_24h": "int", "days_to_resolution_at_ts": "double"}


def inputs_hash(version: str, parameters: str):
    """Digest of what a forecast was made from: model, version, parameters, quote time."""
    return F.sha2(F.to_json(F.struct(
        F.col("model_id"), F.lit(parameters).alias("parameters"), F.col("ts_s").alias("quote_ts"),
        F.lit(version).alias("version"))), 256)


def check_forecasts(rows: DataFrame, version: str = "v1", parameters: str = "{}") -> DataFrame:
    """Add `reject_reason` (null when the row may be appended), the covariates, and the inputs digest."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    reason = (F.when(missing, "missing_key")
              .when(~((F.col("p_yes") > 0) & (F.col("p_yes") < 1)), "p_out_of_range")
              .when(~F.col("p_market_at_ts").between(0, 1), "price_out_of_range"))
    out = rows.withColumn("reject_reason", reason)
    for c, t in COVARIATES.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.withColumn("inputs_hash", inputs_hash(version, parameters))


def forecast_append(rows: DataFrame, ledger_path: str, quarantine_path: str) -> None:
    """Good rows to the ledger by date, the rest to quarantine. Ids already stored are skipped; the ledger is read
    between the batch's first and last date only."""
    from augurmill.sources.archive import has_files
    checked = check_forecasts(rows).withColumn("date", F.to_date(F.timestamp_seconds("ts_s")))
    good = checked.where("reject_reason is null").drop("reject_reason")
    if has_files(rows.sparkSession, ledger_path, "date=*"):
        first, last = good.agg(F.min("date"), F.max("date")).first()
        stored = rows.sparkSession.read.schema(FORECASTS).parquet(ledger_path).where(F.col("date").between(first, last)).select("date", "forecast_id")
        good = good.join(stored, ["date", "forecast_id"], "left_anti")
    good.write.mode("append").partitionBy("date").parquet(ledger_path)
    checked.where("reject_reason is not null").write.mode("append").parquet(quarantine_path)


def market_upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """Last sync wins, but the first `first_seen_s` and an existing `event_id` stay.

    One aggregate over both versions: a market synced many times is reduced
    map-side, and neither side is sorted.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("__new", "last_synced_s")
    kept = ("condition_id", "first_seen_s", "event_id")
    rest = [c for c in both.columns if c not in kept and c != "__new"]
    out = both.groupBy("condition_id").agg(
        F.max_by(F.struct(*rest), rank).alias("r"), F.min_by("first_seen_s", rank).alias("first_seen_s"),
        F.min_by("event_id", F.when(F.col("event_id").isNotNull(), rank)).alias("event_id"))
    return out.select("condition_id", "first_seen_s", "event_id", "r.*").select(*[c for c in both.columns if c != "__new"])


def resolution_upsert(new: DataFrame, old: DataFrame) -> DataFrame:
    """Later payout wins; a venue time once known is never erased."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in ("condition_id", "venue_resolved_s")]
    rank = F.struct("__new", "resolved_s")
    out = both.groupBy("condition_id").agg(
        F.max_by(F.struct(*rest), rank).alias("r"),
        F.max_by("venue_resolved_s", F.when(F.col("venue_resolved_s").isNotNull(), rank)).alias("venue_resolved_s"))
    return out.select("condition_id", "r.*", "venue_resolved_s").select(*old.columns)


def close_resolved(markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Markets with an outcome become closed and inactive."""
    done = resolutions.select("condition_id").distinct().withColumn("__done", F.lit(True))
    hit = F.coalesce("__done", F.lit(False))
    return (markets.join(done, "condition_id", "left")
            .withColumn("closed", F.when(hit, 1).otherwise(F.col("closed")))
            .withColumn("active", F.when(hit, 0).otherwise(F.col("active"))).drop("__done"))


def training_observations(trades: DataFrame, markets: DataFrame, max_per_market: int | None = None) -> DataFrame:
    """One (price, outcome, days left) per market and UTC day: the day's last trade.

    `markets` are the resolved binary ones. The last price is a mergeable
    maximum, so a hot market's trades shrink to one row per day before the shuffle.
    """
    # an unreadable time reads as the far future and fails `days > 0`; a null
    # here would make the planner parse every time twice, to filter it early
    never = F.lit(1 << 60).cast("long")
    t = trades.where("price > 0 and price < 1").select(
        "condition_id", "trade_id", "price", F.coalesce(X.epoch_any("ts_raw"), never).alias("obs_s"))
    days = (F.col("end_s") - F.col("obs_s")) / X.DAY
    joined = t.join(markets.select("condition_id", "category", "payout_yes", "end_s"), "condition_id").where(days > 0)
    last = F.struct("obs_s", "trade_id")
    daily = joined.groupBy("condition_id", X.day_of("obs_s").alias("obs_day")).agg(
        F.max_by("price", last).alias("p_market"), F.max("payout_yes").alias("outcome"),
        F.max("category").alias("category"), F.max_by(days, last).alias("days_to_resolution"))
    if max_per_market is not None:
        from pyspark.sql import Window
        w = Window.partitionBy("condition_id").orderBy("days_to_resolution")
        daily = daily.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_per_market).drop("__r")
    return daily


def volume_sample(markets: DataFrame, n: int, min_volume: float) -> DataFrame:
    """Top n resolved binary markets above a volume floor; a top-k per task."""
    return (markets.where(F.col("volume_num") >= min_volume)
            .orderBy(F.col("volume_num").desc(), "condition_id").limit(n))


def export_latest(forecasts: DataFrame, markets: DataFrame) -> DataFrame:
    """Newest forecasts per (market, model), ties kept, with the market columns."""
    newest = forecasts.groupBy("condition_id", "model_id").agg(F.max("ts_s").alias("ts_s"))
    rows = forecasts.join(newest, ["condition_id", "model_id", "ts_s"], "left_semi")
    return rows.join(markets.select("condition_id", "slug", "question", "category", "end_s", "tier"), "condition_id").select(
        "condition_id", "slug", "question", "category", "end_s", "tier", "model_id", "ts_s", "p_yes",
        "p_market_at_ts", "spread_at_ts")


# The fields of the replication export that this ledger carries.
EXPORT_FIELDS = ["forecast_id", "condition_id", "venue", "category", "tier", "model_id", "ts_s", "p_yes", "p_market_at_ts",
                 "spread_at_ts", "resolved_s", "payout_yes", "event_id", "end_s"]


def export_scored(scored: DataFrame, versions: DataFrame) -> DataFrame:
    """Every resolved forecast: undisputed, forward-only, fixed fields. Not censored: the record is complete."""
    from augurmill.operators.scoring import forward_only
    return forward_only(scored, versions).select(*EXPORT_FIELDS)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def pending_days(days: DataFrame, done: DataFrame, today: int, max_days: int | None = None) -> DataFrame:
    """Closed days not done yet; `max_days` leaves all but the newest to a later run."""
    days = days.where(F.col("day") < today).join(done.select("day"), "day", "left_anti")
    return days if max_days is None else days.orderBy(F.col("day").desc()).limit(max_days)


def ledger_increment(ledger: DataFrame, manifest: DataFrame, id_col: str, cols: list[str],
                     today: int, max_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to write, their manifest rows) for the missing closed days."""
    keyed = ledger.withColumn("day", X.day_of("ts_s"))
    days = pending_days(keyed.select("day").distinct(), manifest, today, max_days)
    rows = keyed.join(days, "day", "left_semi")
    return rows, day_digests(rows, id_col, cols)


def write_increment(rows: DataFrame, path: str) -> None:
    """One folder per day, appended once and never rewritten."""
    rows.write.mode("append").partitionBy("day").option("compression", "gzip").json(path)


def market_increment(markets: DataFrame, forecasts: DataFrame, done: DataFrame, today: int, max_days: int | None = None) -> DataFrame:
    """Markets by the closed day they were first forecast, for the missing days."""
    first = forecasts.groupBy("condition_id").agg(X.day_of(F.min("ts_s")).alias("day"))
    days = pending_days(first.select("day").distinct(), done, today, max_days)
    return markets.join(first.join(days, "day", "left_semi"), "condition_id")


def reference_subset(markets: DataFrame, events: DataFrame, forecasts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Markets with any forecast, and the events they refer to."""
    used = markets.join(forecasts.select("condition_id"), "condition_id", "left_semi")
    return used, events.join(used.select("event_id"), "event_id", "left_semi")


def restore_markets(reference: DataFrame, daily: DataFrame) -> DataFrame:
    """The weekly reference wins; daily rows fill in the markets it lacks."""
    gaps = daily.join(reference.select("condition_id"), "condition_id", "left_anti")
    shared = [c for c in gaps.columns if c in reference.columns]
    first = gaps.select(*shared).dropDuplicates(["condition_id"])
    return (reference.withColumn("origin", F.lit("reference"))
            .unionByName(first.withColumn("origin", F.lit("daily")), allowMissingColumns=True))


def restore_merge(reference: DataFrame, daily: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Row counts of a restore by part, outcomes without a market among them."""
    m = restore_markets(reference, daily)
    kept = resolutions.join(m.select("condition_id"), "condition_id", "left_semi")
    orphans = resolutions.join(m.select("condition_id"), "condition_id", "left_anti")
    return (m.groupBy(F.col("origin").alias("part")).agg(F.count(F.lit(1)).alias("n"))
            .unionByName(kept.agg(F.lit("resolutions").alias("part"), F.count(F.lit(1)).alias("n")))
            .unionByName(orphans.agg(F.lit("orphan_resolutions").alias("part"), F.count(F.lit(1)).alias("n"))))
