"""Queries of the archive, the ledger and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.operators import audit as A
from augurmill.operators import universe as U
from augurmill.plans import scoring as S
from augurmill.plans.registry import query
from augurmill.session import scratch_path
from augurmill.sources import archive, ledger
from augurmill.sources import fixtures as fx

DAY0 = 19723  # 2024-01-01
SHIFT = 946684800  # thirty years: trade times must have the magnitude of epoch seconds today
COLS = ["forecast_id", "condition_id", "ts_s", "p_yes_e6", "p_market_e6"]


def micro_ledger(spark, sf):
    """A ledger with integer ids; prices in millionths, so both engines print them alike."""
    def e6(c):
        return F.round(F.col(c) * 1e6).cast("long")
    return fx.priced(fx.table(spark, sf, "events")).select(
        "forecast_id", "condition_id", "ts_s", e6("p_yes").alias("p_yes_e6"), e6("p_market_at_ts").alias("p_market_e6"))


def digests(spark, sf):
    return A.day_digests(micro_ledger(spark, sf), "forecast_id", COLS)


@query
def ts_bucket(spark, sf):
    q = fx.priced(fx.table(spark, sf, "events")).select("forecast_id", "ts_s")
    return q.select("forecast_id", archive.ts_bucket_column("ts_s", 5).alias("b5"),
                    archive.ts_bucket_column("ts_s", 60).alias("b60"), archive.ts_bucket_column("ts_s", 240).alias("b240"))


@query
def snapshot_dedup(spark, sf):
    return archive.snapshot_dedup(fx.quotes_raw(spark, sf)).select("quote_id", "condition_id", "ts_s", "mid")


@query
def snapshot_append(spark, sf):
    """What an append of the second half of the month adds when its first days are already stored."""
    q = fx.quotes_raw(spark, sf)
    half, overlap = 1704067200 + 15 * X.DAY, 1704067200 + 18 * X.DAY
    stored = archive.with_partitions(archive.snapshot_dedup(q.where(F.col("ts_s") < overlap)))
    return archive.new_rows(q.where(F.col("ts_s") >= half), stored).groupBy(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "hour").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("quote_id").cast("long")).alias("sum_quote_id"))


@query
def snapshot_read(spark, sf):
    """Archive read back from its files: three dates, three columns, markets by semi-join."""
    path = scratch_path(spark, "archive")
    archive.snapshot_append(fx.quotes_raw(spark, sf), path)
    ids = fx.drift_forecasts(spark, sf).where("p_market_at_ts > 0.1D")
    return archive.snapshot_read(spark, path, dates=["2024-01-03", "2024-01-09", "2024-01-21"],
                                 columns=["condition_id", "ts_s", "mid", "open_interest"], ids=ids).select(
        "condition_id", "ts_s", "mid", "open_interest")


@query
def latest_quote(spark, sf):
    return U.latest_quote(fx.snapshots(spark, sf)).select("condition_id", "ts_s", "mid")


def market_versions(spark, sf):
    m = fx.universe(spark, sf).select("condition_id", "event_id", "tier", "closed", "first_seen_s", "last_synced_s", "volume_num")
    old = m.where(F.col("first_seen_s") < 883612800)
    new = (m.where(F.col("first_seen_s") >= 852076800)
           .withColumn("event_id", F.lit(None).cast("string")).withColumn("first_seen_s", F.lit(fx.NOW).cast("long"))
           .withColumn("tier", F.when(F.col("tier") == "tail", "liquid").otherwise(F.col("tier")))
           .withColumn("last_synced_s", F.col("last_synced_s") + 86400))
    return new, old


@query
def market_upsert(spark, sf):
    return ledger.market_upsert(*market_versions(spark, sf))


def resolution_versions(spark, sf):
    r = fx.resolutions(spark, sf).withColumn(
        "venue_resolved_s", F.when(F.col("resolved_s") % 3 == 0, F.col("resolved_s") - 3600))
    old = r.where(F.col("resolved_s") < 915148800)
    new = (r.where(F.col("resolved_s") >= 852076800)
           .withColumn("payout_yes", F.when(F.col("disputed") == 1, 1 - F.col("payout_yes")).otherwise(F.col("payout_yes")))
           .withColumn("resolved_s", F.col("resolved_s") + 7200)
           .withColumn("venue_resolved_s", F.when(F.col("disputed") == 1, F.col("resolved_s"))))
    return new, old


@query
def resolution_upsert(spark, sf):
    return ledger.resolution_upsert(*resolution_versions(spark, sf))


@query
def close_resolved(spark, sf):
    m = fx.universe(spark, sf).withColumn("closed", F.lit(0)).withColumn("active", F.lit(1))
    return ledger.close_resolved(m, fx.resolutions(spark, sf)).select("condition_id", "closed", "active")


@query
def forecast_append(spark, sf):
    """Counts of accepted and quarantined rows; some line items are out of range or lack a price."""
    rows = (fx.forecasts(spark, sf)
            .withColumn("p_yes", F.col("p_market_at_ts") + (F.col("p_yes") - F.col("p_market_at_ts")) * 9)
            .withColumn("p_market_at_ts", F.when(F.col("spread_at_ts") > 0, F.col("p_market_at_ts"))))
    return ledger.check_forecasts(rows).groupBy("model_id", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("inputs_hash").alias("n_inputs"))


@query
def ledger_audit(spark, sf):
    old = micro_ledger(spark, sf)
    new = (old.where("p_market_e6 % 17 <> 0")
           .withColumn("p_yes_e6", F.when(F.col("p_market_e6") % 13 == 0, F.col("p_yes_e6") + 1).otherwise(F.col("p_yes_e6"))))
    return A.ledger_audit(old, new, "forecast_id")


def trades(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    ts = fx.epoch("l_shipdate") + 60 * (pk % 1440) + SHIFT
    raw = (F.when(F.col("l_linenumber") % 3 == 0, ts.cast("string"))
           .when(F.col("l_linenumber") % 3 == 1, (ts * 1000).cast("string"))
           .otherwise(F.concat(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))))
    return li.select(
        F.concat_ws("-", ok.cast("string"), F.col("l_linenumber").cast("string"), pk.cast("string"), F.col("l_suppkey").cast("string"),
                    F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")).alias("trade_id"),
        F.concat(F.lit("m"), ok).alias("condition_id"),
        (((ok * 31 + (pk % 3) * 101) % 997) / 996e0).alias("price"), raw.alias("ts_raw"))


def resolved_markets(spark, sf):
    r = fx.resolutions(spark, sf).where("disputed = 0").select("condition_id", "payout_yes")
    return fx.universe(spark, sf).where("n_outcomes = 2").join(r, "condition_id").withColumn(
        "category", F.coalesce("category", F.lit("unknown"))).withColumn("end_s", F.col("end_s") + SHIFT)


@query
def training_observations(spark, sf):
    return ledger.training_observations(trades(spark, sf), resolved_markets(spark, sf))


@query
def volume_sample(spark, sf):
    return ledger.volume_sample(resolved_markets(spark, sf), 500, 50000.0).select("condition_id", "volume_num", "payout_yes")


@query
def export_latest(spark, sf):
    f = fx.forecasts(spark, sf).select("forecast_id", "condition_id", "model_id", "ts_s", "p_yes", "p_market_at_ts", "spread_at_ts")
    return ledger.export_latest(f, fx.universe(spark, sf))


def exported(spark, sf):
    f = fx.forecasts(spark, sf).drop("event_id", "venue", "category", "neg_risk", "end_s")
    from augurmill.operators import scoring
    rows = scoring.scored_rows(f, fx.resolutions(spark, sf), fx.markets(spark, sf), fx.AS_OF, censor=False)
    return ledger.export_scored(rows, S.versions(spark, sf))


@query
def export_scored(spark, sf):
    return exported(spark, sf)


def older_manifest(spark, sf):
    """Days before the 20th were mirrored already, two of them wrongly."""
    d = digests(spark, sf).where(F.col("day") < DAY0 + 19)
    return d.withColumn("table", F.lit("forecasts")).withColumn(
        "row_count", F.when(F.col("day") == DAY0 + 4, F.col("row_count") + 1).otherwise(F.col("row_count"))).withColumn(
        "sha256", F.when(F.col("day") == DAY0 + 7, F.lit("0")).otherwise(F.col("sha256")))


@query
def ledger_increment(spark, sf):
    done = fx.table(spark, sf, "events").select(X.day_of(fx.epoch("ts")).alias("day")).where(
        F.col("day").between(DAY0, DAY0 + 19)).distinct()
    _, manifest = ledger.ledger_increment(micro_ledger(spark, sf), done, "forecast_id", COLS, DAY0 + 28)
    return manifest


@query
def market_increment(spark, sf):
    done = spark.range(10956, 10960).select(F.col("id").alias("day"))
    return ledger.market_increment(fx.markets(spark, sf), fx.forecasts(spark, sf), done, 10957 + 10).select(
        "day", "condition_id", "venue", "category", "end_s")


@query
def reference_subset(spark, sf):
    m = fx.markets(spark, sf)
    events = fx.table(spark, sf, "customer").select(F.concat(F.lit("e"), "c_custkey").alias("event_id"), "c_name")
    used, ev = ledger.reference_subset(m, events, fx.forecasts(spark, sf).where("model_id = 'm7_crossvenue'"))
    return used.groupBy(F.lit("markets").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("condition_id").alias("first_id")).unionByName(
        ev.groupBy(F.lit("events").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")))


@query
def restore_merge(spark, sf):
    m = fx.universe(spark, sf)
    reference = m.where(F.col("first_seen_s") < 883612800).drop("open_interest")
    daily = m.where(F.col("first_seen_s").between(852076800, 930000000)).drop("slug")
    return ledger.restore_merge(reference, daily, fx.resolutions(spark, sf))


@query
def daily_digest(spark, sf):
    recorded = spark.range(DAY0, DAY0 + 3).select(F.col("id").alias("day"))
    return A.daily_digest(micro_ledger(spark, sf), recorded, "forecast_id", COLS, DAY0 - 2, DAY0 + 30, (DAY0 + 30) * X.DAY)


def records(spark, sf):
    """A true record per day, an empty day, and on every fifth day a second, false one."""
    d = digests(spark, sf)
    good = d.withColumn("record_id", F.col("day") * 10)
    false = d.where((F.col("day") % 5) == 0).withColumn("record_id", F.col("day") * 10 + 1).withColumn("last_id", F.col("last_id") - 1)
    lost = d.where((F.col("day") % 11) == 0).withColumn("sha256", F.lit("x"))
    empty = spark.range(DAY0 - 1, DAY0).select(
        F.col("id").alias("day"), F.lit(0).cast("long").alias("row_count"), F.lit(None).cast("long").alias("first_id"),
        F.lit(None).cast("long").alias("last_id"), F.lit(A.EMPTY).alias("sha256"), (F.col("id") * 10).alias("record_id"))
    kept = good.join(lost.select("day"), "day", "left_anti").unionByName(lost.withColumn("record_id", F.col("day") * 10))
    return kept.unionByName(false).unionByName(empty)


@query
def verify_records(spark, sf):
    return A.verified_days(A.verify_records(micro_ledger(spark, sf), records(spark, sf), "forecast_id", COLS))


@query
def export_digest(spark, sf):
    return A.export_digest(micro_ledger(spark, sf), "forecast_id", COLS)


@query
def export_verify(spark, sf):
    rows = micro_ledger(spark, sf)
    manifest = A.export_digest(rows.withColumn("p_yes_e6", F.col("p_yes_e6") + (F.col("forecast_id") == 3).cast("int")), "forecast_id", COLS)
    return A.export_verify(rows, manifest, "forecast_id")


@query
def increment_verify(spark, sf):
    return A.increment_verify(digests(spark, sf).withColumn("table", F.lit("forecasts")), older_manifest(spark, sf))


@query
def manifest_backfill(spark, sf):
    d = digests(spark, sf).withColumn("table", F.lit("forecasts"))
    mirrored = d.where(F.col("day") < DAY0 + 24)
    return A.manifest_backfill(d, mirrored, older_manifest(spark, sf))
