"""Tiers, exclusions, categories, eligibility and stable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.session import cut

# The universe policy.
LIQUID, TAIL = "liquid", "tail"
DEPTH_FLOOR = {LIQUID: 250.0, TAIL: 10.0}
LIQUIDITY_FLOOR = {LIQUID: (100_000.0, 1_000_000.0), TAIL: (1_000.0, 5_000.0)}
INTEREST_FLOOR = {LIQUID: (5_000.0, 100.0), TAIL: (0.0, 0.0)}
INTEREST_VENUE = "kalshi"
PRICE_BOUNDS = (0.05, 0.95)
MAX_QUOTE_AGE_MIN = {LIQUID: 15, TAIL: 90}
PRIORITY_CATEGORIES = ("economics", "weather", "politics", "geopolitics", "entertainment")
EXCLUDED_CATEGORIES = ("crypto", "equities")
CONTROL_CATEGORY = "sports"
CRYPTO_HINTS = ("crypto", "bitcoin", "btc", "ethereum", "eth ", "solana", "dogecoin", "xrp")
EQUITY_HINTS = ("market cap", "valuation", "fdv", "fully diluted")


def market_text() -> Column:
    parts = [F.coalesce(F.nullif(F.trim(F.lower("category")), F.lit("")), F.lit("unknown")), F.col("slug"), F.col("question")]
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def has_hint(text: Column, hints: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for hint in hints:
        out = out | text.contains(hint)
    return out


def in_bounds(mid) -> Column:
    return (X.col(mid) > PRICE_BOUNDS[0]) & (X.col(mid) < PRICE_BOUNDS[1])


def measured_depth() -> Column:
    """Sum of both sides; unknown when neither was measured, one missing side counts 0."""
    bid, ask = F.col("bid_depth_usd"), F.col("ask_depth_usd")
    return F.when(bid.isNotNull() | ask.isNotNull(),
                  F.coalesce(bid, F.lit(0.0)) + F.coalesce(ask, F.lit(0.0)))


def latest_quote(quotes: DataFrame, since_s: int | None = None, until_s: int | None = None) -> DataFrame:
    """Newest row per market without its ladders: a mergeable aggregate, so a hot
    market is reduced before the shuffle and ladder columns are never read."""
    q = quotes
    if since_s is not None:
        q = q.where(F.col("ts_s") >= since_s)
    if until_s is not None:
        q = q.where(F.col("ts_s") <= until_s)
    rest = [c for c in q.columns if c not in ("condition_id", "bids", "asks", "bids_json", "asks_json", "props")]
    return (q.groupBy("condition_id").agg(F.max_by(F.struct(*rest), F.struct("ts_s", "quote_id")).alias("q"))
            .select("condition_id", "q.*"))


def tier_assign(markets: DataFrame, latest: DataFrame) -> DataFrame:
    depths = latest.select("condition_id", measured_depth().alias("depth_usd"))
    m = markets.drop("tier").join(depths, "condition_id", "left")
    text, depth = market_text(), F.col("depth_usd")
    by_interest = X.venue_of() == INTEREST_VENUE
    no_book = ~by_interest & (F.col("order_book") == 0)
    target = ~by_interest & (F.coalesce(F.col("category").isin(*EXCLUDED_CATEGORIES), F.lit(False))
                             | has_hint(text, CRYPTO_HINTS) | has_hint(text, EQUITY_HINTS))

    def clears(level: str) -> Column:
        a = F.when(by_interest, F.coalesce("volume_num", F.lit(0.0))).otherwise(F.coalesce("liquidity_num", F.lit(0.0)))
        b = F.when(by_interest, F.coalesce("open_interest", F.lit(0.0))).otherwise(F.coalesce("volume_num", F.lit(0.0)))
        lo_a = F.when(by_interest, INTEREST_FLOOR[level][0]).otherwise(LIQUIDITY_FLOOR[level][0])
        lo_b = F.when(by_interest, INTEREST_FLOOR[level][1]).otherwise(LIQUIDITY_FLOOR[level][1])
        return F.when(depth.isNotNull(), depth >= DEPTH_FLOOR[level]).otherwise((a >= lo_a) & (b >= lo_b))

    tier = (F.when(no_book | target, "ignored").when(clears(LIQUID), LIQUID)
            .when(clears(TAIL), TAIL).otherwise("ignored"))
    reason = (F.when(no_book, "no_orderbook").when(target, "crypto_price_target")
              .when(F.col("tier") == "ignored", "low_liquidity"))
    return m.withColumn("tier", tier).withColumn("reason", reason)


def exclusion_flags(markets: DataFrame, latest: DataFrame, now_s: int) -> DataFrame:
    """Every reason a market is kept out, as an array; empty when none applies."""
    m = markets.join(latest.select("condition_id", "mid"), "condition_id", "left")
    text = market_text()
    crypto = has_hint(text, CRYPTO_HINTS)
    short = crypto & (((F.col("end_s") - F.col("start_s")) <= X.DAY) | ((F.col("end_s") - now_s) <= X.DAY))
    pairs = [
        ("non_binary", F.col("n_outcomes") != 2),
        ("sub_24h", short),
        ("price_target", crypto | has_hint(text, EQUITY_HINTS)),
        ("tail_price", F.col("tier").isin(LIQUID, TAIL) & F.col("mid").isNotNull() & ~in_bounds("mid")),
    ]
    from augurmill.operators.scoring import labels
    return m.withColumn("reasons", labels(pairs))


def exclusion_log(occurrences: DataFrame) -> DataFrame:
    """One row per (venue, market, reason, day), the earliest kept."""
    return (occurrences.groupBy("venue", "venue_native_id", "reason", X.day_of("ts_s").alias("day"))
            .agg(F.min("ts_s").alias("ts_s")))


def category_map(tagged: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """First category by priority whose tags intersect the market's, else `unknown`."""
    hits = (tagged.select("condition_id", F.explode("tags").alias("raw_tag")).join(taxonomy, "raw_tag")
            .groupBy("condition_id").agg(F.min_by("category", F.struct("priority", "category")).alias("category")))
    return (tagged.select("condition_id").join(hits, "condition_id", "left")
            .withColumn("category", F.coalesce("category", F.lit("unknown"))))


def category_drift(tagged: DataFrame, taxonomy: DataFrame) -> DataFrame:
    tags = tagged.select(F.explode("tags").alias("raw_tag")).groupBy("raw_tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(taxonomy.select("raw_tag").distinct(), "raw_tag", "left_anti")


def event_from_key(markets: DataFrame) -> DataFrame:
    """Cluster id = venue and the first two dash segments of the native key."""
    parts = F.split("venue_native_id", "-")
    event = F.when(F.size(parts) >= 2, F.concat(X.venue_of(), F.lit(":"), F.array_join(F.slice(parts, 1, 2), "-")))
    return markets.withColumn("event_id", F.coalesce(F.col("event_id"), event))


def event_link(edges: DataFrame, existing: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """Pairwise links to one event id per connected component.

    Labels shrink to the component minimum. Each round takes the smallest label
    among neighbours (a mergeable minimum, so a hub is combined map-side), then
    jumps to the label's own label, which halves long chains. A round ends in a
    reliable checkpoint; the loop stops when no label changed.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label"))
                 .withColumnRenamed("src", "node"))
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnRenamed("node", "dst"), "dst")
                .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near")))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                   F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = cut(lowered.join(hop, "label", "left")
                    .select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            break
    else:
        raise RuntimeError("event_link did not settle; raise max_rounds")
    minted = F.concat(F.lit("evt_"), F.substring(F.sha2("label", 256), 1, 16))
    if existing is None:
        return labels.select(F.col("node").alias("condition_id"), minted.alias("event_id"))
    known = existing.where("event_id is not null").select(F.col("condition_id").alias("node"), "event_id")
    reused = labels.join(known, "node").groupBy("label").agg(F.min("event_id").alias("reused"))
    return (labels.join(reused, "label", "left")
            .select(F.col("node").alias("condition_id"), F.coalesce("reused", minted).alias("event_id")))


def bottom_k_sample(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """The k ids per venue with the smallest sha256("seed:venue:id"): stable as the set grows.

    The rank bound is pushed below the shuffle by Spark's window group limit,
    so a hot venue sends k rows per task.
    """
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), "venue", "condition_id"), 256)
    rank = F.row_number().over(Window.partitionBy("venue").orderBy("draw", "condition_id"))
    return (ids.select(X.venue_of().alias("venue"), "condition_id").withColumn("draw", draw).withColumn("rank", rank)
            .where(F.col("rank") <= k).drop("draw"))


def open_markets(markets: DataFrame) -> DataFrame:
    return markets.where(F.col("tier").isin(LIQUID, TAIL) & (F.col("active") == 1) & (F.col("closed") == 0))


def sample_guard(ids: DataFrame, markets: DataFrame, sample: DataFrame) -> DataFrame:
    """Drop control-category ids outside the sample; every other id passes."""
    control = markets.where(F.col("category") == CONTROL_CATEGORY).select("condition_id")
    outside = control.join(sample.select("condition_id"), "condition_id", "left_anti")
    return ids.join(outside, "condition_id", "left_anti")


def control_members(forecasts: DataFrame, markets: DataFrame) -> DataFrame:
    """The control set as the ledger has it: control-category markets ever forecast."""
    control = markets.where(F.col("category") == CONTROL_CATEGORY).select(X.venue_of().alias("venue"), "condition_id")
    return control.distinct().join(forecasts.select("condition_id"), "condition_id", "left_semi").select("venue", "condition_id")


def screened_states(markets: DataFrame, quotes: DataFrame, sample: DataFrame, now_s: int) -> DataFrame:
    """Open markets with their newest quote and, where rejected, the first reason."""
    latest = latest_quote(quotes, now_s - now_s % X.DAY - X.DAY, now_s)
    m = sample_guard(open_markets(markets), markets, sample)
    kept = [c for c in latest.columns if c == "condition_id" or c not in m.columns]
    s = m.join(latest.select(*kept).withColumnRenamed("ts_s", "quote_s"), "condition_id", "left")
    limit = F.when(F.col("tier") == LIQUID, MAX_QUOTE_AGE_MIN[LIQUID]).otherwise(MAX_QUOTE_AGE_MIN[TAIL])
    age_min = (F.lit(now_s) - F.col("quote_s")) / 60
    reason = (F.when(F.col("end_s").isNotNull() & (F.col("end_s") <= now_s), "ended")
              .when(F.col("mid").isNull(), "unpriced")
              .when(age_min > limit, "stale")
              .when(~in_bounds("mid"), "out_of_bounds"))
    days = F.greatest(F.lit(0.0), (F.col("end_s") - now_s) / X.DAY)
    return (s.withColumn("reason", reason).withColumn("days_to_resolution", F.when(F.col("end_s").isNotNull(), days))
            .withColumn("depth_usd", measured_depth()))


def eligible_states(markets: DataFrame, quotes: DataFrame, sample: DataFrame, now_s: int) -> DataFrame:
    return screened_states(markets, quotes, sample, now_s).where("reason is null").drop("reason")


def eligibility_rejects(markets: DataFrame, quotes: DataFrame, sample: DataFrame, now_s: int) -> DataFrame:
    return (screened_states(markets, quotes, sample, now_s).where("reason is not null")
            .groupBy(X.venue_of().alias("venue"), "reason").agg(F.count(F.lit(1)).alias("n")))


def due_filter(states: DataFrame, models: list[str], ledger: DataFrame, moves: DataFrame, now_s: int,
               cadence_h: float = 24, min_gap_h: float = 6, trigger: float = 0.10) -> DataFrame:
    """(market, model) pairs due now. One join replaces a lookup per pair."""
    last = (ledger.where(F.col("ts_s") <= now_s).join(states.select("condition_id"), "condition_id", "left_semi")
            .groupBy("condition_id", "model_id").agg(F.max("ts_s").alias("last_s")))
    pairs = states.withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in models])))
    age_h = (F.lit(now_s) - F.col("last_s")) / X.HOUR
    days_apart = now_s // X.DAY - X.day_of("last_s")
    due = (F.col("last_s").isNull() | (age_h >= cadence_h)
           | ((days_apart >= cadence_h / 24) & (age_h >= min_gap_h))
           | (F.col("move").isNotNull() & (age_h >= min_gap_h) & (F.abs("move") > trigger)))
    return (pairs.join(last, ["condition_id", "model_id"], "left")
            .join(moves.select("condition_id", "move"), "condition_id", "left").where(due))


def price_move_24h(quotes: DataFrame, now_s: int) -> DataFrame:
    """Newest mid minus newest mid at or before a day ago; three days are read."""
    day0 = now_s - now_s % X.DAY - 2 * X.DAY
    past = F.col("ts_s") <= now_s - X.DAY
    order = F.struct("ts_s", "quote_id")
    q = quotes.where((F.col("ts_s") >= day0) & (F.col("ts_s") <= now_s))
    return (q.groupBy("condition_id").agg(
        F.max_by("mid", order).alias("now_mid"), F.count(F.when(past, 1)).alias("n_past"),
        F.max_by(F.when(past, F.col("mid")), F.when(past, order)).alias("past_mid"))
        .where("n_past > 0").select("condition_id", (F.col("now_mid") - F.col("past_mid")).alias("move")))


def rank_candidates(markets: DataFrame, latest: DataFrame, k: int) -> DataFrame:
    """Top k by liquidity: a bounded top-k per task, ranked once k rows are left."""
    pool = (markets.where((F.col("tier") == LIQUID) & (F.col("active") == 1) & (F.col("closed") == 0)
                          & F.col("category").isin(*PRIORITY_CATEGORIES))
            .join(latest.select("condition_id", "mid").where(in_bounds("mid")), "condition_id"))
    top = pool.orderBy(F.col("liquidity_num").desc(), "condition_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("liquidity_num").desc(), "condition_id"))
    return top.select("condition_id", "category", "liquidity_num", rank.alias("rank"))


def boundary_randomize(ranked: DataFrame, k: int, half: int, seed: str) -> DataFrame:
    """Ranks around k are chosen by hash so that k stay in all; `ranked` holds ranks up to k+half."""
    start = max(0, k - half)
    rows = ranked.where(F.col("rank") <= k + half)
    in_band = F.col("rank") > start
    draw = F.sha2(F.concat_ws(":", F.lit(seed), "condition_id"), 256)
    order = F.row_number().over(Window.partitionBy("in_band").orderBy("draw", "condition_id"))
    return (rows.withColumn("in_band", in_band).withColumn("draw", draw).withColumn("band_rank", order)
            .where(~F.col("in_band") | (F.col("band_rank") <= k - start))
            .select("condition_id", "rank", F.col("in_band").cast("int").alias("randomized")))


def topic_candidates(markets: DataFrame, k: int, oversample: int = 5) -> DataFrame:
    """Even share per priority category, one market per event, by volume."""
    share = max(1, k // len(PRIORITY_CATEGORIES))
    by_volume = (F.col("volume_num").desc(), F.col("condition_id"))
    pool = markets.where((F.col("tier") == LIQUID) & (F.col("active") == 1) & (F.col("closed") == 0)
                         & F.col("category").isin(*PRIORITY_CATEGORIES)).withColumn("cluster_id", X.cluster_key())
    top = (pool.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(*by_volume)))
           .where(F.col("r") <= share * oversample))
    one = (top.withColumn("e", F.row_number().over(Window.partitionBy("category", "cluster_id").orderBy(*by_volume)))
           .where("e = 1"))
    return (one.withColumn("slot", F.row_number().over(Window.partitionBy("category").orderBy(*by_volume)))
            .where(F.col("slot") <= share).select("category", "slot", "condition_id", "cluster_id"))


def backlog(markets: DataFrame, resolutions: DataFrame, now_s: int) -> DataFrame:
    """Unresolved markets that are closed, past their end, or unseen for a day."""
    waiting = ((F.col("closed") == 1) | (F.col("end_s") < now_s) | (F.col("last_synced_s") < now_s - X.DAY))
    return markets.where(waiting).join(resolutions.select("condition_id"), "condition_id", "left_anti")


def watch_candidates(markets: DataFrame, resolutions: DataFrame, venue: str, now_s: int, n: int) -> DataFrame:
    """Least recently checked first, never checked before that."""
    return (backlog(markets.where(X.venue_of() == venue), resolutions, now_s)
            .orderBy(F.col("checked_s").asc_nulls_first(), "condition_id").limit(n)
            .select("condition_id", "checked_s"))
