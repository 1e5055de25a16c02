"""Paired skill, intervals, sequences, calibration, ranked scores, growth and drift."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from augurmill.functions import exprs as X
from augurmill.functions.prefix import running

P, Q, Y = "p_yes", "p_market_at_ts", "payout_yes"

# Row values whose sums carry every paired statistic. Texts, parsed per session.
_CLIP = "least(1D - 1e-6D, greatest(1e-6D, {0}))"
_LOSS = f"-(payout_yes * ln({_CLIP}) + (1 - payout_yes) * ln(1 - {_CLIP}))"
PAIRED_SUMS = {
    "s_n": "1",
    "s_model": "pow(p_yes - payout_yes, 2)",
    "s_market": "pow(p_market_at_ts - payout_yes, 2)",
    "s_skill": "pow(p_market_at_ts - payout_yes, 2) - pow(p_yes - payout_yes, 2)",
    "s_ll_model": _LOSS.format("p_yes"),
    "s_ll_market": _LOSS.format("p_market_at_ts"),
}


def cluster_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per (cell, cluster): the only shuffle that sees ledger rows."""
    return rows.groupBy(*by, "cluster_id").agg(*[F.sum(F.expr(v)).alias(n) for n, v in PAIRED_SUMS.items()])


def paired_from_clusters(clusters: DataFrame, by: list[str]) -> DataFrame:
    mean = F.col("s_skill") / F.col("s_n")
    total = F.sum("s_n")
    sd = F.stddev_samp(mean)
    return clusters.groupBy(*by).agg(
        total.cast("long").alias("n"),
        F.count(F.lit(1)).alias("n_clusters"),
        (F.sum("s_model") / total).alias("brier_model"),
        (F.sum("s_market") / total).alias("brier_market"),
        (F.sum("s_skill") / total).alias("skill"),
        (F.sum("s_ll_model") / total).alias("log_loss_model"),
        (F.sum("s_ll_market") / total).alias("log_loss_market"),
        (2.8 * sd / F.sqrt(F.count(F.lit(1)))).alias("mde"),
        F.avg(mean).alias("skill_cluster_mean"),
        F.coalesce(F.var_samp(mean), F.lit(0.0)).alias("skill_cluster_var"),
    )


def paired_skill(rows: DataFrame, by: list[str]) -> DataFrame:
    """Brier and log loss of model and market, skill and its detectable effect."""
    return paired_from_clusters(cluster_sums(rows, by), by).drop("skill_cluster_mean", "skill_cluster_var")


def cluster_sequence(rows: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    """One mean per cluster with its earliest entry; `seq` numbers them by (entry, cluster)."""
    means = cluster_means(rows, by, value)
    return running(means, by, ["entry_s", "cluster_id"], count="seq")


def cluster_means(rows: DataFrame, by: list[str], value: Column | None = None) -> DataFrame:
    value = X.skill(P, Q, Y) if value is None else value
    return rows.groupBy(*by, "cluster_id").agg(
        F.avg(value).alias("diff"), F.min("entry_s").alias("entry_s"), F.count(F.lit(1)).alias("n_rows"))


def rho_per_n(alpha: float) -> float:
    """1 / (-W(-alpha^2/e) - 1) on the lower Lambert branch, by Newton on w + ln(-w)."""
    target = math.log(alpha * alpha) - 1
    w = target - math.log(-target)
    for _ in range(60):
        w -= (w + math.log(-w) - target) / (1 + 1 / w)
    return 1 / (-w - 1)


def radius(var: Column, n: Column, n_target: Column, alpha: float) -> Column:
    """Half-width of the normal-mixture confidence sequence after n clusters."""
    rho = n_target * F.lit(rho_per_n(alpha))
    v = n * var
    return F.sqrt((v + rho) * F.log((v + rho) / (alpha * alpha * rho))) / n


def sequence_columns(df: DataFrame, mean: str, var: str, n: str, alpha: float, prefix: str = "cs") -> DataFrame:
    half = radius(F.col(var), F.col(n), F.col(n), alpha)
    lo, hi = F.col(mean) - half, F.col(mean) + half
    return (df.withColumn(f"{prefix}_center", F.col(mean)).withColumn(f"{prefix}_lo", lo)
            .withColumn(f"{prefix}_hi", hi)
            .withColumn(f"{prefix}_covers_zero", ((lo <= 0) & (hi >= 0)).cast("int")))


def confidence_sequence(rows: DataFrame, by: list[str], alpha: float = 0.05,
                        value: Column | None = None) -> DataFrame:
    """The sequence at the full sample. Order does not matter there, so this is two aggregates."""
    cells = cluster_means(rows, by, value).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.avg("diff").alias("__mean"),
        F.coalesce(F.var_samp("diff"), F.lit(0.0)).alias("__var"))
    return sequence_columns(cells, "__mean", "__var", "n_clusters", alpha).drop("__mean", "__var")


def confidence_path(rows: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """The sequence at every prefix, from running sums over cluster means."""
    means = cluster_means(rows, by)
    totals = means.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"))
    path = running(means, by, ["entry_s", "cluster_id"],
                   sums={"sum_d": F.col("diff"), "sum_dd": F.col("diff") * F.col("diff")}, count="seq")
    n = F.col("seq")
    center = F.col("sum_d") / n
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("sum_dd") - n * center * center) / (n - 1))).otherwise(0.0)
    half = radius(var, n, F.col("n_total"), alpha)
    return path.join(totals, by).select(
        *by, "cluster_id", "entry_s", "seq", center.alias("cs_center"),
        (center - half).alias("cs_lo"), (center + half).alias("cs_hi"))


# ---------------------------------------------------------------- strata and bins

# Inner edges of the price strata, left-closed.
STRATA = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
MIN_STRATUM_N, MIN_STRATA = 30, 3


def step_index(value: Column, edges) -> Column:
    """How many edges lie at or below the value."""
    out = F.lit(0)
    for edge in edges:
        out = out + F.when(value >= F.lit(float(edge)), 1).otherwise(0)
    return out


def pool_strata(strata: DataFrame, by: list[str]) -> DataFrame:
    """Inverse-variance pooling of (n, mean, var) per stratum; null below MIN_STRATA."""
    ok = F.col("n") >= MIN_STRATUM_N
    weight = F.when(ok, 1 / F.greatest(F.col("var") / F.col("n"), F.lit(1e-12)))
    qualified = F.count(F.when(ok, 1))
    return strata.groupBy(*by).agg(
        F.when(qualified >= MIN_STRATA, F.sum(weight * F.col("mean")) / F.sum(weight)).alias("skill_pw"),
        qualified.alias("n_strata"))


def stratified_skill(rows: DataFrame, by: list[str]) -> DataFrame:
    d = X.skill(P, Q, Y)
    strata = rows.groupBy(*by, step_index(F.col(Q), STRATA).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.var_samp(d).alias("var"))
    return pool_strata(strata, by)


def calibration_bins(rows: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Counts, mean forecast and outcome rate per equal-width bin; empty bins stay."""
    edges = [float(e) for e in np.linspace(0, 1, k + 1)]
    found = rows.groupBy(*by, step_index(F.col(P), edges[1:-1]).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(P).alias("p_mean"), F.avg(Y).alias("y_rate"))
    # at most k entries per cell, so the map is small by construction
    packed = found.groupBy(*by).agg(F.map_from_entries(
        F.collect_list(F.struct("bin", F.struct("n", "p_mean", "y_rate")))).alias("bins"))
    at = F.try_element_at("bins", F.col("bin"))
    return packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        *by, "bin",
        F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1).alias("bin_lo"),
        F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 2).alias("bin_hi"),
        F.coalesce(at["n"], F.lit(0)).alias("n"), at["p_mean"].alias("p_mean"), at["y_rate"].alias("y_rate"))


# ---------------------------------------------------------------- resampling

# Poisson(1) cumulative probabilities 0..11; the prime modulus of the replicates' number sequence and its step.
POISSON_CDF = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12))
MODULUS, STEP = 2147483647, 1140671485


def _weights(clusters: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """Each cluster with the replicates that draw it, and how often: `rep`, `w` (above 0), Poisson with mean 1.
    `drawn_sums` adds up the same weights without a row for each.

    One hash per cluster starts its sequence: two numbers h and g below a prime. Replicate r takes
    the fifth power of h + r * STEP, which permutes the numbers below that prime, and adds g. So a cell of any
    size is drawn in one way, rows never meet, and sums are formed before anything is shuffled.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("cluster_id"))
    part = lambda at: F.conv(F.substring("__digest", at, 8), 16, 10).cast("long") % MODULUS
    # few rows become many here: a count of partitions that was asked for is not merged again
    conf, context = clusters.sparkSession.conf, clusters.sparkSession.sparkContext
    spread = clusters.repartition(max(int(conf.get("spark.sql.shuffle.partitions")), 2 * context.defaultParallelism), *by, "cluster_id")
    start = spread.withColumn("__digest", F.sha2(text, 256)).withColumns({"__h": part(1), "__g": part(9)}).drop("__digest")
    drawn = start.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("__x", (F.col("__h") + F.col("rep").cast("long") * STEP) % MODULUS)
    square = drawn.withColumn("__y", F.col("__x") * F.col("__x") % MODULUS)
    fifth = F.col("__y") * F.col("__y") % MODULUS * F.col("__x") % MODULUS
    # through a generator, so that the number is made once and not in every branch of the search
    share = square.withColumn("__u", F.explode(F.array((fifth + F.col("__g")) % MODULUS / F.lit(float(MODULUS)))))
    return share.withColumn("w", step_index(F.col("__u"), POISSON_CDF)).where("w > 0").drop("__h", "__g", "__x", "__y", "__u")


def _interval(means: DataFrame, by: list[str], alpha: float, value: str = "m") -> DataFrame:
    """Linear-interpolated percentiles over the replicates of a cell."""
    return means.groupBy(*by).agg(
        F.expr(f"percentile({value}, {alpha / 2}D)").alias("ci_lo"),
        F.expr(f"percentile({value}, {1 - alpha / 2}D)").alias("ci_hi"))


#: Draws that a task makes at once, clusters times replicates: they stay in a core's cache.
DRAWS = 1 << 15
#: Sums that a task holds at once, cells times replicates.
HELD_SUMS = 1 << 20
#: The numbers below the modulus from which on a cluster is drawn once, twice and so on.
DRAWN_FROM = np.array([next(x for x in range(max(0, int(c * MODULUS) - 2), MODULUS) if x / MODULUS >= c) for c in POISSON_CDF if (MODULUS - 1) / MODULUS >= c], "i4")


def weight_table(h: np.ndarray, g: np.ndarray, replicates: int) -> np.ndarray:
    """The weights of `_weights` as a table, a row for each cluster.

    The modulus is 2 ** 31 - 1, so a number's upper bits may be added to its lower 31; 64 bits hold every product.
    """
    m, bits = np.uint64(MODULUS), np.uint64(31)

    def folded(x, times):
        for _ in range(times):
            upper = x >> bits
            x &= m
            x += upper
        return x

    def below(x):  # from below twice the modulus
        return np.minimum(x, x - m)  # what would be negative is large

    x = below(h.astype("u8")[:, None] + np.arange(1, replicates + 1, dtype="u8") * np.uint64(STEP) % m)
    y = folded(x * x, 1)
    y *= y
    y = folded(y, 2)
    y *= x
    y = folded(y, 2)
    y = below(y)
    y += g.astype("u8")[:, None]
    last = below(y).astype("i4")
    w = np.zeros(last.shape, "i1")
    for least in DRAWN_FROM:
        w += last >= least
    return w


def drawn_sums(clusters: DataFrame, by: list[str], values: list[str], replicates: int, seed: int, inside: list[str] | None = None) -> DataFrame:
    """Sums of `values` times the weight for each cell (`by` and `inside`) and replicate that draws any of its clusters.

    `clusters` has one row for each cell and cluster; its draw does not depend on `inside`. Each task adds up
    the draws of its own clusters as products of a table of weights and the values, and a sum for each cell and
    replicate is all it sends on: neither draws nor clusters are shuffled for it.
    """
    cell = by + (inside or [])
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("cluster_id"))
    part = lambda at: F.conv(F.substring("__digest", at, 8), 16, 10).cast("long") % MODULUS
    staged = clusters.withColumn("__digest", F.sha2(text, 256)).select(*cell, part(1).alias("__h"), part(9).alias("__g"), *[F.col(v).cast("double").alias(v) for v in values])
    fields = {f.name: f for f in staged.schema}
    names = [*cell, "rep", "__drawn", *values]

    def step(batches):
        sums: dict[tuple, np.ndarray] = {}

        def rows():
            for key, s in sums.items():
                reps = np.flatnonzero(s[:, 0] > 0)
                columns = [pa.array([v] * len(reps), to_arrow_type(fields[c].dataType)) for v, c in zip(key, cell)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(reps + 1, pa.int32()), *[pa.array(s[reps, j]) for j in range(len(values) + 1)]], names)
            sums.clear()

        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in cell]))
            known: dict[tuple, int] = {}
            of = np.fromiter((known.setdefault(k, len(known)) for k in keys), "i8", len(keys))
            h, g = b.column("__h").to_numpy(), b.column("__g").to_numpy()
            v = np.column_stack([np.ones(len(keys)), *[b.column(x).to_numpy() for x in values]])
            order = np.argsort(of, kind="stable")
            ends = np.cumsum(np.bincount(of, minlength=len(known)))
            for key, start, end in zip(known, np.append(0, ends), ends):
                total = sums.setdefault(key, np.zeros((replicates, v.shape[1])))
                for lo in range(start, end, max(1, DRAWS // replicates)):
                    at = order[lo:min(end, lo + max(1, DRAWS // replicates))]
                    total += weight_table(h[at], g[at], replicates).T.astype("f8") @ v[at]
            if len(sums) * replicates > HELD_SUMS:
                yield from rows()
        yield from rows()

    kinds = ", ".join([*[f"`{c}` {fields[c].dataType.simpleString()}" for c in cell], "rep int", *[f"{x} double" for x in ("__drawn", *values)]])
    return staged.mapInArrow(step, kinds).groupBy(*cell, "rep").agg(*[F.sum(x).alias(x) for x in values])


def resample(clusters: DataFrame, by: list[str], replicates: int, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval of sum(s)/sum(n) over resampled clusters; `clusters` is (by, cluster_id, n, s). A replicate that draws
    no cluster of a cell counts for nothing there."""
    sums = drawn_sums(clusters.select(*by, "cluster_id", "n", "s"), by, ["n", "s"], replicates, seed)
    return _interval(sums.select(*by, (F.col("s") / F.col("n")).alias("m")), by, alpha)


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.skill(P, Q, Y)).alias("s"))


def bootstrap_ci(rows: DataFrame, by: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Cluster bootstrap of the mean skill."""
    return resample(_moments(rows, by), by, replicates, seed)


def bootstrap_ci_poisson(rows: DataFrame, by: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """As `bootstrap_ci`, which draws in this way at every size."""
    return bootstrap_ci(rows, by, replicates, seed)


def stratified_ci(rows: DataFrame, by: list[str], replicates: int = 2000, seed: int = 0) -> DataFrame:
    """Cluster bootstrap of the whole stratified estimator, on moments only: a cluster's strata are drawn together."""
    d = X.skill(P, Q, Y)
    moments = rows.groupBy(*by, "cluster_id", step_index(F.col(Q), STRATA).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    strata = (drawn_sums(moments, by, ["n", "s", "q"], replicates, seed, ["stratum"])
              .withColumn("mean", F.col("s") / F.col("n"))
              .withColumn("var", F.when(F.col("n") > 1, (F.col("q") - F.col("s") * F.col("mean")) / (F.col("n") - 1))))
    per_rep = pool_strata(strata, by + ["rep"])
    out = per_rep.groupBy(*by).agg(
        F.count("skill_pw").alias("n_reps"),
        F.expr("percentile(skill_pw, 0.025D)").alias("lo"), F.expr("percentile(skill_pw, 0.975D)").alias("hi"))
    enough = F.col("n_reps") >= replicates // 2
    return out.select(*by, "n_reps", F.when(enough, F.col("lo")).alias("ci_lo"), F.when(enough, F.col("hi")).alias("ci_hi"))


# ---------------------------------------------------------------- ranked probability

def bucketed_events(rows: DataFrame, legs: DataFrame, by: list[str]) -> DataFrame:
    """Legs of each exclusive event's latest complete pass, with the event's verdict.

    A pass is complete when it holds every leg first seen by then. That is a
    count against a running count, so no pass is ever paired with every leg.
    Returns one row per leg of an admitted pass; `verdict` is `ok`,
    `unordered` or `not_one_winner`. `incomplete_events` counts the rest.
    """
    legs = legs.select("event_id", "condition_id", "first_seen_s", "order_value")
    at = by + ["event_id", "ts_s"]
    latest_row = (rows.where("event_id is not null and event_id <> ''")
                  .groupBy(*at, "condition_id")
                  .agg(F.max_by(F.struct(P, Q, Y), F.col("forecast_id")).alias("v")))
    got = (latest_row.join(legs, ["event_id", "condition_id"])
           .where("first_seen_s <= ts_s").select(*at, "condition_id", "order_value", "v.*"))
    # required legs at each pass: legs sort before passes at the same instant
    timeline = (legs.select("event_id", F.col("first_seen_s").alias("at_s"), F.lit(0).alias("kind"),
                            F.col("condition_id").alias("tie"), F.lit(1).alias("leg"))
                .unionByName(got.select("event_id", F.col("ts_s").alias("at_s")).distinct()
                             .select("event_id", "at_s", F.lit(1).alias("kind"), F.lit("").alias("tie"),
                                     F.lit(0).alias("leg"))))
    required = (running(timeline, ["event_id"], ["at_s", "kind", "tie"], sums={"required": F.col("leg")})
                .where("kind = 1").select("event_id", F.col("at_s").alias("ts_s"), "required"))
    passes = (got.groupBy(*at).agg(F.count(F.lit(1)).alias("held")).join(required, ["event_id", "ts_s"])
              .where("held = required"))
    chosen = passes.groupBy(*by, "event_id").agg(F.max("ts_s").alias("ts_s"))
    picked = got.join(chosen, at)
    verdicts = picked.groupBy(*by, "event_id").agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct("order_value").alias("k_orders"),
        F.count(F.when(F.col(Y) == 1, 1)).alias("winners"),
        F.sum(P).alias("sum_model"), F.sum(Q).alias("sum_market"))
    verdict = (F.when(F.col("k_orders") < F.col("k"), "unordered")
               .when(F.col("winners") != 1, "not_one_winner").otherwise("ok"))
    return picked.join(verdicts.withColumn("verdict", verdict), by + ["event_id"])


def rps(legs: DataFrame, by: list[str]) -> DataFrame:
    """Ranked probability score of model and market per admitted event with two or more legs."""
    ok = legs.where("verdict = 'ok' and k > 1")
    def share(p, total):
        return F.when(F.col(total) > 0, F.col(p) / F.col(total)).otherwise(1 / F.col("k"))
    steps = running(ok, by + ["event_id"], ["order_value"], sums={
        "cdf_model": share(P, "sum_model"), "cdf_market": share(Q, "sum_market"), "step": F.col(Y)})
    return steps.groupBy(*by, "event_id").agg(
        F.max("k").alias("k"),
        (F.sum(X.brier("cdf_model", "step")) / (F.max("k") - 1)).alias("rps_model"),
        (F.sum(X.brier("cdf_market", "step")) / (F.max("k") - 1)).alias("rps_market"))


def rps_skill(scores: DataFrame, by: list[str], replicates: int = 2000, min_events: int = 20) -> DataFrame:
    diff = F.col("rps_market") - F.col("rps_model")
    cells = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("rps_model").alias("rps_model"),
        F.avg("rps_market").alias("rps_market"), F.avg(diff).alias("skill_rps")).where(F.col("n_events") >= min_events)
    events = scores.select(*by, F.col("event_id").alias("cluster_id"), F.lit(1).cast("long").alias("n"), diff.alias("s"))
    return cells.join(resample(events, by, replicates), by)


# ---------------------------------------------------------------- costs and growth

def taker_rate(rows: DataFrame, fees: DataFrame) -> DataFrame:
    """Fee in force on the forecast day: exact category first, then the venue default, else 0.

    The schedule is folded into one short list per venue and looked up beside
    each row, so rows are not shuffled for it: the planner broadcasts the
    schedule as long as its file is small.
    """
    lists = fees.groupBy(F.col("venue").alias("__fee_venue")).agg(
        F.collect_list(F.struct("category", "effective_day", "taker_rate")).alias("__fees"))
    day = X.day_of("ts_s")
    in_force = F.filter("__fees", lambda f: (f["effective_day"] <= day)
                        & (f["category"].eqNullSafe(F.col("category")) | (f["category"] == "default")))
    best = F.array_max(F.transform(in_force, lambda f: F.struct(
        f["category"].eqNullSafe(F.col("category")).cast("int").alias("exact"), f["effective_day"].alias("d"), f["taker_rate"].alias("rate"))))
    return (rows.join(lists, X.venue_of() == F.col("__fee_venue"), "left")
            .withColumn("taker_rate", F.coalesce(best["rate"], F.lit(0.0))).drop("__fee_venue", "__fees"))


def growth_columns(rows: DataFrame, kelly: float = 0.2, cap: float = 0.05) -> DataFrame:
    """Log bankroll multiple of the model's side bought at the touch plus the fee; 0 without an edge."""
    yes = F.col(P) > F.col(Q)
    q = F.when(yes, F.col(P)).otherwise(1 - F.col(P))
    spread = F.greatest(F.lit(0.0), F.coalesce(F.col("spread_at_ts"), F.lit(0.0)))
    touch = F.when(yes, F.col(Q)).otherwise(1 - F.col(Q)) + spread / 2
    cost = touch * (1 + F.col("taker_rate") * (1 - touch))
    valid = (F.col("__cost") > 0) & (F.col("__cost") < 1)
    star = F.when(valid, (q - F.col("__cost")) / (1 - F.col("__cost"))).otherwise(0.0)
    f = F.when(star > 0, F.least(star * kelly, F.lit(cap))).otherwise(0.0)
    won = (F.col(Y) == 1) == yes
    bet = F.col("__f") > 0
    gain = F.when(won, F.log(1 - F.col("__f") + F.col("__f") / F.col("__cost"))).otherwise(F.log(1 - F.col("__f")))
    return (rows.withColumn("__cost", cost).withColumn("__f", f)
            .withColumn("growth", F.when(bet, gain).otherwise(0.0))
            .withColumn("bet", bet.cast("int")).drop("__cost", "__f"))


def net_growth(rows: DataFrame, fees: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    grown = growth_columns(taker_rate(rows, fees))
    clusters = grown.groupBy(*by, "cluster_id").agg(
        F.avg("growth").alias("g"), F.sum("bet").alias("bets"), F.count(F.lit(1)).alias("n"))
    cells = clusters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.avg("g").alias("net_growth"),
        F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("__var"),
        (F.sum("bets") / F.sum("n")).alias("net_bet_share"))
    return sequence_columns(cells, "net_growth", "__var", "n_clusters", alpha, "net").drop("__var", "net_center")


# ---------------------------------------------------------------- drift

def quote_asof(targets: DataFrame, quotes: DataFrame, tolerance_s: int = 3 * X.HOUR) -> DataFrame:
    """Nearest quote within the tolerance of each (condition_id, target_s); a tie takes the earlier.

    Time is cut into bins as wide as the tolerance, and each quote is copied to
    its own bin and both neighbours. Inside a bin the last quote at or before
    and the first after the target come from two sorted windows, so targets are
    never paired with every quote near them. Both inputs are made unique on
    (market, second) first, which bounds a bin however hot its market.
    """
    wanted = targets.select("condition_id", "target_s").distinct()
    bin_of = F.floor(F.col("at_s") / tolerance_s)
    marks = wanted.select("condition_id", F.col("target_s").alias("at_s"), F.lit(True).alias("is_target"),
                          F.lit(None).cast("struct<ts_s:bigint,mid:double>").alias("q")).withColumn("bin", bin_of)
    # only quotes in or beside a bin with a target are copied
    near = marks.select("condition_id", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("own_bin")).distinct()
    close = quotes.withColumn("own_bin", F.floor(F.col("ts_s") / tolerance_s)).join(near, ["condition_id", "own_bin"], "left_semi")
    unique = close.groupBy("condition_id", "own_bin", "ts_s").agg(F.min_by(F.struct("mid"), F.col("quote_id"))["mid"].alias("mid"))
    spread = unique.select(
        "condition_id", F.col("ts_s").alias("at_s"), F.lit(False).alias("is_target"), F.struct("ts_s", "mid").alias("q"),
        F.explode(F.array(F.col("own_bin") - 1, F.col("own_bin"), F.col("own_bin") + 1)).alias("bin"))
    both = marks.unionByName(spread)
    # a quote at the target's own second must sort before it in both directions
    rows = Window.unboundedPreceding, Window.currentRow
    part = Window.partitionBy("condition_id", "bin")
    back = part.orderBy(F.col("at_s"), F.col("is_target")).rowsBetween(*rows)
    ahead = part.orderBy(F.col("at_s").desc(), F.col("is_target")).rowsBetween(*rows)
    seen = (both.withColumn("prev", F.last("q", ignorenulls=True).over(back))
            .withColumn("next", F.last("q", ignorenulls=True).over(ahead))
            .where("is_target"))
    before = F.col("at_s") - F.col("prev.ts_s")
    after = F.col("next.ts_s") - F.col("at_s")
    far = F.lit(tolerance_s + 1)
    use_prev = F.coalesce(before, far) <= F.coalesce(after, far)
    nearest = (seen.withColumn("near", F.when(use_prev, F.col("prev")).otherwise(F.col("next")))
               .where(F.least(F.coalesce(before, far), F.coalesce(after, far)) <= tolerance_s)
               .select("condition_id", F.col("at_s").alias("target_s"), F.col("near.ts_s").alias("quote_s"),
                       F.col("near.mid").alias("mid")))
    return targets.join(nearest, ["condition_id", "target_s"], "left")


def drift_rows(forecasts: DataFrame, quotes: DataFrame, gaps: DataFrame, horizons=(24, 72)) -> DataFrame:
    """(forecast, horizon) rows with a signed drift, or flagged `gap`."""
    f = forecasts.where(F.abs(F.col(P) - F.col(Q)) >= 1e-9)
    wide = (f.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
            .withColumn("target_s", F.col("ts_s") + F.col("horizon") * X.HOUR))
    from augurmill.operators.health import overlaps_gap
    wide = overlaps_gap(wide, gaps, "ts_s", "target_s")
    hit = quote_asof(wide.where("not in_gap"), quotes)
    signed = F.signum(F.col(P) - F.col(Q)) * (F.col("mid") - F.col(Q))
    return (hit.withColumn("drift", signed).unionByName(
        wide.where("in_gap"), allowMissingColumns=True))


def drift(forecasts: DataFrame, quotes: DataFrame, gaps: DataFrame, horizons=(24, 72)) -> DataFrame:
    return drift_rows(forecasts, quotes, gaps, horizons).groupBy("model_id", "horizon").agg(
        F.count("drift").alias("n"), F.avg("drift").alias("mean_signed_drift"),
        F.count(F.when(F.col("in_gap"), 1)).alias("dropped_for_gap"))


def drift_trust(rows: DataFrame, control: DataFrame, min_n: int = 30, max_corr: float = 0.15) -> DataFrame:
    """Whether drift can be trusted: over the control set, where no model has skill, it must not follow skill.

    `rows` hold (condition_id, drift, skill) of all forecasts, `control` the condition_ids of the control set. One row:
    n, reason (no_control, no_data, insufficient_n, zero_variance, checked), correlation, trusted.
    """
    members = control.select("condition_id").distinct()
    usable = rows.join(members, "condition_id", "left_semi").where("drift is not null and skill is not null").agg(
        F.count(F.lit(1)).alias("n"), F.corr("drift", "skill").alias("__corr"),
        F.stddev_pop("drift").alias("__sd_d"), F.stddev_pop("skill").alias("__sd_s"))
    usable = usable.crossJoin(members.agg(F.count(F.lit(1)).alias("__members")))  # one row each
    flat = (F.coalesce("__sd_d", F.lit(0.0)) == 0) | (F.coalesce("__sd_s", F.lit(0.0)) == 0)
    reason = (F.when(F.col("__members") == 0, "no_control").when(F.col("n") == 0, "no_data").when(F.col("n") < min_n, "insufficient_n")
              .when(flat, "zero_variance").otherwise("checked"))
    corr = F.when(F.col("reason") == "checked", F.col("__corr"))
    return (usable.withColumn("reason", reason).withColumn("correlation", corr)
            .withColumn("trusted", F.coalesce(F.abs(F.col("correlation")) <= max_corr, F.lit(True)).cast("int"))
            .select("n", "reason", "correlation", "trusted"))


def eval_latest(runs: DataFrame, withheld_venue: str, withheld_before_s: int) -> DataFrame:
    """Newest run per (model, window, venue, category); null keys group together."""
    keys = ["model_id", "window_label", "venue", "category"]
    old = (X.venue_of() == withheld_venue) & (F.col("ts_s") < withheld_before_s)
    kept = runs.where(~old)
    newest = kept.groupBy(*keys).agg(F.max("ts_s").alias("ts_s"))
    k, n = kept.alias("k"), newest.alias("n")
    on = F.col("k.ts_s") == F.col("n.ts_s")
    for key in keys:
        on = on & F.col(f"k.{key}").eqNullSafe(F.col(f"n.{key}"))
    return k.join(n, on, "left_semi")
