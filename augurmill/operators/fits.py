"""Fits, correlations, weights, grids, replays and gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.functions import weights as W
from augurmill.functions.prefix import running
from augurmill.operators import estimators as E
from augurmill.operators import models as M

MIN_BUCKET_N, MIN_VENUE_N = 100, 5
ALLOWED_VENUES = ("polymarket", "kalshi", "metaculus")


def _training(obs: DataFrame) -> DataFrame:
    """Observations of one bucket, venue, price and outcome as one row with their number `n`.

    Prices move in ticks, so the steps of a fit read far fewer rows than there are observations; and never more.
    """
    return obs.select(X.horizon_bucket("days_to_resolution").alias("bucket"), X.venue_of().alias("venue")
                      if "venue" in obs.columns else F.lit(X.DEFAULT_VENUE).alias("venue"),
                      X.logit("p_market").alias("x"), F.col("outcome").alias("y")).where("bucket is not null").groupBy(
                          "bucket", "venue", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _newton_sums(data: DataFrame, keys: list[str], theta: dict[tuple, tuple[float, float]]) -> dict[tuple, np.ndarray]:
    """Gradient and Hessian sums per key at the current parameters: one aggregate, a handful of rows back."""
    alpha, beta = F.lit(None).cast("double"), F.lit(None).cast("double")
    for key, (a, b) in theta.items():
        here = F.lit(True)
        for name, value in zip(keys, key):
            here = here & (F.col(name) == F.lit(value))
        alpha, beta = F.when(here, F.lit(a)).otherwise(alpha), F.when(here, F.lit(b)).otherwise(beta)
    p = X.sigmoid(alpha + beta * F.col("x"))
    r, w = F.col("n") * (F.col("y") - F.col("p")), F.col("n") * F.col("p") * (1 - F.col("p"))
    rows = (data.withColumn("p", p).where("p is not null").groupBy(*keys).agg(
        F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(w).alias("h00"),
        F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"),
        F.sum(-F.col("n") * (F.col("y") * F.log(X.clip("p", X.EPS, 1 - X.EPS))
                + (1 - F.col("y")) * F.log(1 - X.clip("p", X.EPS, 1 - X.EPS)))).alias("nll")).collect())
    return {tuple(row[k] for k in keys): np.array([row["g0"], row["g1"], row["h00"], row["h01"], row["h11"], row["nll"]])
            for row in rows}


class _Descent:
    """Newton with step halving for one small parameter vector; the data stays in Spark."""

    def __init__(self, start: np.ndarray):
        self.base, self.step, self.loss, self.done = start, np.zeros(len(start)), np.inf, False
        self.point = start

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Sums at `point`: accept it and aim anew, or come half the way back."""
        if loss <= self.loss + 1e-9 * (1 + abs(loss)):
            self.base, self.loss = self.point, loss
            self.step = np.linalg.solve(hessian + 1e-9 * np.eye(len(gradient)), gradient)
        else:
            self.step = self.step / 2
        self.point = self.base + self.step
        self.done = bool(np.abs(self.step).max() < 1e-10)


def _settled(fits: dict[str, _Descent], max_steps: int) -> None:
    """A fit that has not come to rest is no result."""
    open_ = sorted(b for b, d in fits.items() if not d.done)
    if open_:
        raise RuntimeError(f"no convergence within {max_steps} steps: {', '.join(open_)}")


def fit_recalibration(obs: DataFrame, max_steps: int = 60) -> DataFrame:
    """Logistic alpha, beta per horizon bucket, all buckets in one aggregate per Newton step."""
    data = _training(obs).persist()
    try:
        counts = {r["bucket"]: r["n"] for r in data.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
        fits = {b: _Descent(np.array([0.0, 1.0])) for b, n in counts.items() if n >= MIN_BUCKET_N}
        for _ in range(max_steps):
            if all(d.done for d in fits.values()):
                break
            theta = {(b,): tuple(float(v) for v in d.point) for b, d in fits.items()}
            for (b,), s in _newton_sums(data, ["bucket"], theta).items():
                fits[b].take(float(s[5]), s[:2], np.array([[s[2], s[3]], [s[3], s[4]]]))
        _settled(fits, max_steps)
    finally:
        data.unpersist()
    rows = [(b, float(d.base[0]), float(d.base[1]), int(counts[b]), d.loss) for b, d in sorted(fits.items())]
    return obs.sparkSession.createDataFrame(rows, "bucket string, alpha double, beta double, n bigint, nll double")


def fit_hier(obs: DataFrame, max_steps: int = 80) -> DataFrame:
    """Global curve per bucket plus ridge-shrunk venue offsets.

    Each step reads one aggregate per (bucket, venue); the joint Newton system
    has two unknowns per venue and is solved from those sums. The ridge weight
    is bucket_n / venue_n. The global row has a null venue.
    """
    data = _training(obs).where(F.col("venue").isin(*ALLOWED_VENUES)).persist()
    try:
        n = {(r["bucket"], r["venue"]): r["n"]
             for r in data.groupBy("bucket", "venue").agg(F.sum("n").alias("n")).collect()}
        size: dict[str, int] = {}
        for (b, _), c in n.items():
            size[b] = size.get(b, 0) + c
        offset_venues = {b: [v for v in sorted(v for bb, v in n if bb == b) if n[(b, v)] >= MIN_VENUE_N]
                         for b in size if size[b] >= MIN_BUCKET_N}
        fits = {b: _Descent(np.concatenate([[0.0, 1.0], np.zeros(2 * len(vs))])) for b, vs in offset_venues.items()}

        def slots(b: str, v: str) -> list[np.ndarray]:
            vs = offset_venues[b]
            return [np.arange(2)] + ([2 + 2 * vs.index(v) + np.arange(2)] if v in vs else [])

        for _ in range(max_steps):
            if all(d.done for d in fits.values()):
                break
            theta = {(b, v): tuple(float(x) for x in sum(fits[b].point[at] for at in slots(b, v)))
                     for b, v in n if b in fits}
            sums = _newton_sums(data, ["bucket", "venue"], theta)
            for b, vs in offset_venues.items():
                k = len(fits[b].point)
                loss, g, h = 0.0, np.zeros(k), np.zeros((k, k))
                for (bb, v), s in sums.items():
                    if bb == b:
                        loss += float(s[5])
                        for i in slots(b, v):
                            g[i] += s[:2]
                            for j in slots(b, v):
                                h[np.ix_(i, j)] += np.array([[s[2], s[3]], [s[3], s[4]]])
                for i, v in enumerate(vs):
                    ridge, at = size[b] / n[(b, v)], 2 + 2 * i + np.arange(2)
                    loss += ridge * float((fits[b].point[at] ** 2).sum())
                    g[at] -= 2 * ridge * fits[b].point[at]
                    h[at, at] += 2 * ridge
                fits[b].take(loss, g, h)
        _settled(fits, max_steps)
    finally:
        data.unpersist()
    rows = []
    for b, vs in sorted(offset_venues.items()):
        p = fits[b].base
        rows.append((b, None, float(p[0]), float(p[1]), int(size[b])))
        rows += [(b, v, float(p[2 + 2 * i]), float(p[3 + 2 * i]), int(n[(b, v)])) for i, v in enumerate(vs)]
    return obs.sparkSession.createDataFrame(rows, "bucket string, venue string, alpha double, beta double, n bigint")


def bounded_step(new: DataFrame, old: DataFrame, keys: list[str], values: list[str], max_step: float = 0.2) -> DataFrame:
    """A fit held near the parameters in use: each of `values` moves at most `max_step` of its old value.

    Keys meet null-safe, so a hierarchical fit's global rows (no venue) are bounded too. A key that
    is new, and an old value that is null or zero, bound nothing; a new null stays. Both sides are
    parameter tables of a few rows.
    """
    before = old.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.max(v).alias(f"__old_{v}") for v in values])
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"__{k}"))
    step = {v: F.when(F.col(v).isNotNull(), X.bounded(v, f"__old_{v}", max_step)) for v in values}
    return new.join(before, met, "left").withColumns(step).select(*new.columns)


def isotonic_bins(obs: DataFrame, curves: DataFrame, max_bins: int = 20) -> DataFrame:
    """Near-equal bins by price with their rates made monotone, and the curve's deviation.

    Positions come from distributed prefix counts. The pooled rate at k is the
    largest, over i up to k, of the smallest mean of bins i..j, j from k on.
    """
    rows = obs.select(X.horizon_bucket("days_to_resolution").alias("bucket"), "p_market", "outcome", "obs_id").where("bucket is not null")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    placed = running(rows, ["bucket"], ["p_market", "obs_id"], count="pos").join(sizes, "bucket")
    k = F.least(F.lit(max_bins).cast("long"), F.greatest(F.lit(1).cast("long"), F.expr("n div 10")))
    placed = placed.withColumn("k", k).withColumn("q", F.expr("n div k")).withColumn("r", F.expr("n % k"))
    cut = F.col("r") * (F.col("q") + 1)
    at = F.col("pos") - 1
    bin_of = F.when(at < cut, F.expr("(pos - 1) div (q + 1)")).otherwise(F.expr("r + (pos - 1 - r * (q + 1)) div q"))
    bins = placed.withColumn("bin", bin_of.cast("int")).groupBy("bucket", "bin").agg(
        F.avg("p_market").alias("p_center"), F.avg("outcome").alias("empirical"), F.count(F.lit(1)).alias("n"))
    # at most 20 bins per bucket from here on
    left = bins.select("bucket", F.col("bin").alias("i"))
    right = bins.select("bucket", F.col("bin").alias("m"), (F.col("empirical") * F.col("n")).alias("s"), "n")
    from pyspark.sql import Window
    to_j = Window.partitionBy("bucket", "i").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    spans = (left.join(right, "bucket").where("m >= i")
             .withColumn("mean", F.sum("s").over(to_j) / F.sum("n").over(to_j)))
    lows = (spans.withColumn("bin", F.explode(F.sequence("i", "m"))).groupBy("bucket", "i", "bin").agg(F.min("mean").alias("low")))
    iso = lows.groupBy("bucket", "bin").agg(F.max("low").alias("isotonic"))
    fitted = X.sigmoid(F.col("alpha") + F.col("beta") * X.logit("p_center"))
    return (bins.join(iso, ["bucket", "bin"]).join(curves.select("bucket", "alpha", "beta"), "bucket", "left")
            .withColumn("deviation", F.abs(fitted - F.col("isotonic"))).drop("alpha", "beta"))


def fit_base_rates(training: DataFrame, live: DataFrame, min_n: int = 50) -> DataFrame:
    """Mean outcome per category over markets; a live market overrides its training row.

    The row with a null category counts the markets dropped for having none.
    """
    t = training.select("condition_id", F.coalesce("category", F.lit("unknown")).alias("category"), "outcome",
                        F.struct(F.lit(0).alias("live"), (-F.col("order")).alias("o")).alias("rank"))
    v = live.select("condition_id", "category", "outcome", F.struct(F.lit(1).alias("live"), F.lit(0).cast("long").alias("o")).alias("rank"))
    markets = t.unionByName(v).groupBy("condition_id").agg(F.max_by(F.struct("category", "outcome"), F.col("rank")).alias("m"))
    rates = markets.groupBy("m.category").agg(F.count(F.lit(1)).alias("n"), F.avg("m.outcome").alias("base_rate"))
    return (rates.where((F.col("n") >= min_n) | F.col("category").isNull())
            .withColumn("base_rate", F.when(F.col("category").isNotNull(), F.col("base_rate"))))


def fit_pool_weights(scored: DataFrame, min_resolved: int = 100) -> DataFrame:
    """softmax(-Brier / 0.05) per category, then bounds; categories below the minimum are absent."""
    by_model = (scored.where(F.col("model_id").isin(*M.POOLABLE) & F.col("category").isNotNull())
                .groupBy("category", "model_id").agg(F.avg(X.brier(E.P, E.Y)).alias("brier"), F.count(F.lit(1)).alias("n")))
    totals = by_model.groupBy("category").agg(
        F.sum("n").alias("n_resolved"), F.sum(F.exp(-F.col("brier") / 0.05)).alias("z")).where(F.col("n_resolved") >= min_resolved)
    raw = by_model.join(totals, "category").select(
        "category", "model_id", (F.exp(-F.col("brier") / 0.05) / F.col("z")).alias("raw"))
    return W.bound_weights(raw).join(totals.select("category", "n_resolved"), "category")


def pair_correlation(forecasts: DataFrame, models: list[str], min_n: int = 30) -> DataFrame:
    """Pearson of logit p per category and model pair on the same (market, ts).

    The models of a moment become columns by mergeable maxima, so there is no
    self-join; pairs are expanded from that one row.
    """
    point = forecasts.where(F.col("model_id").isin(*models)).groupBy("condition_id", "ts_s").agg(
        F.max(F.coalesce("category", F.lit("unknown"))).alias("category"),
        *[F.max_by(F.when(F.col("model_id") == m, F.col(E.P)), F.when(F.col("model_id") == m, F.col("forecast_id"))).alias(m)
          for m in models])
    pairs = [(a, b) for i, a in enumerate(sorted(models)) for b in sorted(models)[i + 1:]]
    wide = F.array(*[F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), X.logit(a).alias("x"), X.logit(b).alias("y"))) for a, b in pairs])
    rows = point.select("category", F.explode(F.array_compact(wide)).alias("p")).select("category", "p.*")
    return (rows.groupBy("category", "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.corr("x", "y").alias("rho"))
        .where((F.col("n") >= min_n) & (F.col("vx") > 0) & (F.col("vy") > 0)).drop("vx", "vy"))


def mean_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("category").agg(F.avg("rho").alias("rho_bar"), F.count(F.lit(1)).alias("n_pairs"))


def daily_pair_correlation(quotes: DataFrame, pairs: DataFrame, from_s: int, until_s: int, min_days: int = 10) -> DataFrame:
    """Correlation of logit mid per confirmed pair over days both sides have a last price."""
    q = quotes.where((F.col("ts_s") >= from_s) & (F.col("ts_s") < until_s))
    daily = (q.groupBy("condition_id", X.day_of("ts_s").alias("day")).agg(F.max_by("mid", F.struct("ts_s", "quote_id")).alias("mid"))
             .where("mid is not null"))
    a = daily.select(F.col("condition_id").alias("a"), "day", X.logit("mid").alias("x"))
    b = daily.select(F.col("condition_id").alias("b"), "day", X.logit("mid").alias("y"))
    cells = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "day"]).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_days"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.corr("x", "y").alias("rho"))
    return cells.where((F.col("n_days") >= min_days) & (F.col("vx") > 0) & (F.col("vy") > 0)).drop("vx", "vy")


# ---------------------------------------------------------------- walk-forward grids

EXPONENT_GRID = (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5)
EVIDENCE_GRID = {"k": (0.08, 0.15, 0.25), "tau_days": (3.0, 5.0, 10.0), "max_shift": (0.5, 0.8, 1.2)}


def split_oldest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add `pos`, `n` and `is_train`: the oldest int(0.8 n) of each cell."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else rows.agg(F.count(F.lit(1)).alias("n"))
    placed = running(rows, by, order, count="pos")
    joined = placed.join(sizes, by) if by else placed.crossJoin(sizes)  # without keys: one row of totals
    return joined.withColumn("is_train", F.col("pos") <= F.floor(F.lit(0.8) * F.col("n")))


def fit_exponent(rows: DataFrame, by: list[str], min_n: int = 60) -> DataFrame:
    """Exponent with the least Brier on the oldest 80 %, and its Brier on the rest."""
    parts = split_oldest(rows, by, ["entry_s", "forecast_id"]).where(F.col("n") >= min_n)
    p = X.sigmoid(F.col("a") * X.logit("p_pooled"))
    score = X.brier(p, "outcome")
    scores = (parts.withColumn("a", F.explode(F.array(*[F.lit(a) for a in EXPONENT_GRID])))
              .groupBy(*by, "a").agg(
                  F.avg(F.when(F.col("is_train"), score)).alias("train_brier"),
                  F.avg(F.when(~F.col("is_train"), score)).alias("validation_brier"),
                  F.count(F.when(F.col("is_train"), 1)).alias("n_train"),
                  F.count(F.when(~F.col("is_train"), 1)).alias("n_validation"))
              .where("n_train > 0 and n_validation > 0"))
    best = F.min_by(F.struct("a", "train_brier", "validation_brier", "n_train", "n_validation"), F.struct("train_brier", "a"))
    return scores.groupBy(*by).agg(best.alias("r")).select(*by, "r.*")


def fit_evidence_params(items: DataFrame, runs: DataFrame, min_runs: int = 150, folds: int = 5) -> DataFrame:
    """Score of each (k, tau, cap): mean Brier of the training folds after the first.

    A run's shift is linear in k, so its items are summed once per tau; the
    grid then expands one short row per run.
    """
    taus = EVIDENCE_GRID["tau_days"]
    sums = (items.join(runs.select("condition_id", "forecast_s"), "condition_id").groupBy("condition_id")
            .agg(*[F.sum(M.evidence_delta(1.0, t)).alias(f"tau_{i}") for i, t in enumerate(taus)]))
    parts = split_oldest(runs, [], ["entry_s", "condition_id"]).where((F.col("n") >= min_runs) & F.col("is_train"))
    fold_size = F.greatest(F.lit(1).cast("long"), F.floor(F.floor(F.lit(0.8) * F.col("n")) / folds))
    placed = (parts.withColumn("fold", F.floor((F.col("pos") - 1) / fold_size)).where(f"fold between 1 and {folds - 1}")
              .join(sums, "condition_id", "left"))
    grid = [(k, i, c) for k in EVIDENCE_GRID["k"] for i in range(len(taus)) for c in EVIDENCE_GRID["max_shift"]]
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(taus[i]).alias("tau_days"), F.lit(c).alias("max_shift"),
                               (F.lit(k) * F.coalesce(F.col(f"tau_{i}"), F.lit(0.0))).alias("total")) for k, i, c in grid])
    scored = placed.select("fold", "p_market", "outcome", F.explode(cells).alias("g")).select("fold", "p_market", "outcome", "g.*")
    shift = F.least(F.col("max_shift"), F.greatest(-F.col("max_shift"), F.col("total")))
    p = X.sigmoid(X.logit("p_market") + shift)
    by_fold = scored.groupBy("k", "tau_days", "max_shift", "fold").agg(F.avg(X.brier(p, "outcome")).alias("brier"))
    return by_fold.groupBy("k", "tau_days", "max_shift").agg(F.avg("brier").alias("score"), F.count(F.lit(1)).alias("n_folds"))


def best_evidence_params(scores: DataFrame) -> DataFrame:
    """The grid's row of the least score; ties by the smaller parameters."""
    return scores.orderBy("score", "k", "tau_days", "max_shift").limit(1)


def surprise_pairs(nowcasts: DataFrame, actuals: DataFrame) -> DataFrame:
    return nowcasts.join(actuals, ["series", "period"]).withColumn("surprise", F.col("actual") - F.col("nowcast"))


def fit_surprise_sd(pairs: DataFrame, min_periods: int = 12, holdout: int = 8) -> DataFrame:
    """Sample sd of all but the newest `holdout` surprises, and the holdout's negative log likelihood."""
    newest = running(pairs.withColumn("__neg", -F.col("period")), ["series"], ["__neg"], count="age").drop("__neg")
    train = F.col("age") > holdout
    fits = newest.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(train, 1)).alias("n_train"),
        F.greatest(F.stddev_samp(F.when(train, F.col("surprise"))), F.lit(X.EPS)).alias("sd"),
        F.sum(F.when(~train, F.col("surprise") * F.col("surprise"))).alias("ss"), F.count(F.when(~train, 1)).alias("n_validation"))
    nll = F.col("n_validation") * 0.5 * F.log(2 * F.pi() * F.col("sd") * F.col("sd")) + F.col("ss") / (2 * F.col("sd") * F.col("sd"))
    return fits.where(F.col("n") >= min_periods).select("series", "sd", "n_train", "n_validation", nll.alias("val_nll"))


def mwu_weights(experts: DataFrame, pairs: DataFrame, threshold: float = 0.8, min_resolved: int = 100) -> DataFrame:
    """exp(eta * average growth), eta = sqrt(8 ln N / t); correlated models share one ceiling."""
    members = experts.where(F.col("model_id").isin(*M.POOLABLE))
    totals = members.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_models"), F.sum("n_forecasts").alias("n_resolved"), F.max("n_forecasts").alias("t"),
        F.max("avg_log_wealth").alias("top")).where((F.col("n_models") >= 2) & (F.col("n_resolved") >= min_resolved))
    eta = F.sqrt(8 * F.log(F.col("n_models")) / F.greatest(F.col("t"), F.lit(1)))
    e = members.join(totals, "category").withColumn("e", F.exp(eta * (F.col("avg_log_wealth") - F.col("top"))))
    z = e.groupBy("category").agg(F.sum("e").alias("z"))
    links = pairs.where(F.col("rho") >= threshold).groupBy("category").agg(F.collect_list(F.concat_ws("|", "a", "b")).alias("links"))
    raw = (e.join(z, "category").join(links, "category", "left")
           .select("category", "model_id", (F.col("e") / F.col("z")).alias("raw"), "links"))
    return W.bound_weights_by_group(raw).join(totals.select("category", "n_resolved"), "category")


# ---------------------------------------------------------------- replay and gates

def pool_replay_rows(scored: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Each member's newest forecast by the last ensemble moment of every resolved market.

    One as-of join and a mergeable maximum replace a lookup per market.
    """
    last = scored.where("model_id = 'm4_ensemble'").groupBy("condition_id").agg(
        F.max("ts_s").alias("pool_s"), F.max(E.Y).alias("outcome"), F.max(F.coalesce("category", F.lit("unknown"))).alias("category"),
        F.max("cluster_id").alias("cluster_id"), F.max("entry_s").alias("entry_s"))
    m = forecasts.where(F.col("model_id").isin(*M.POOLABLE)).select("condition_id", "model_id", "ts_s", "forecast_id", E.P)
    members = (m.join(last, "condition_id").where("ts_s <= pool_s").groupBy("condition_id", "model_id")
               .agg(F.max_by(E.P, F.struct("ts_s", "forecast_id")).alias(E.P)))
    enough = members.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_members")).where("n_members >= 2")
    return members.join(enough, "condition_id").join(last, "condition_id")


def replay_curves(rows: DataFrame, params: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Predictions of every parameter version on the same rows; no fit for the bucket keeps the price."""
    each = rows.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))
    z = F.col("alpha") + F.col("beta") * X.logit("p_market")
    return (each.withColumn("bucket", X.horizon_bucket("days_to_resolution"))
            .join(params.select("version", "bucket", "alpha", "beta"), ["version", "bucket"], "left")
            .withColumn("p", F.coalesce(X.sigmoid(z), F.col("p_market"))).drop("alpha", "beta"))


def replay_weights(members: DataFrame, weights: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Pooled prediction per market and weight version (long `members`, as from pool_replay_rows)."""
    each = members.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))
    known = weights.select("version", "category").distinct().withColumn("__weighted", F.lit(True))
    raw = (each.join(weights.select("version", "category", "model_id", "weight"), ["version", "category", "model_id"], "left")
           .join(known, ["version", "category"], "left")
           .withColumn("w", F.when(F.col("__weighted"), F.coalesce("weight", F.lit(0.0))).otherwise(1.0)))
    pooled = raw.groupBy("version", "condition_id").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * X.logit(E.P)).alias("swl"), F.avg(X.logit(E.P)).alias("plain"),
        F.max("outcome").alias("outcome"), F.max("cluster_id").alias("cluster_id"), F.max("entry_s").alias("entry_s"))
    return pooled.withColumn("p", X.sigmoid(F.when(F.col("sw") > 0, F.col("swl") / F.col("sw")).otherwise(F.col("plain")))).drop(
        "sw", "swl", "plain")


def replay_exponent(rows: DataFrame, params: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """Extremized pool per version: params are (version, category, a, rho_bar, n_members)."""
    each = rows.withColumn("version", F.explode(F.array(*[F.lit(v) for v in versions])))
    a = X.discounted_exponent("a", F.greatest(F.lit(1), F.round("n_members")), "rho_bar")
    return (each.join(params.select("version", "category", "a", "rho_bar", "n_members"), ["version", "category"], "left")
            .withColumn("p", F.when(F.col("a").isNull(), F.col("p_pooled")).otherwise(X.sigmoid(a * X.logit("p_pooled"))))
            .drop("a", "rho_bar", "n_members"))


def paired_versions(replayed: DataFrame, row_key: list[str], champion: str, challenger: str) -> DataFrame:
    """One row per replayed row with `diff` = champion Brier minus challenger Brier."""
    def brier(v):
        return F.max(F.when(F.col("version") == v, X.brier("p", "outcome")))
    return (replayed.groupBy(*row_key).agg((brier(champion) - brier(challenger)).alias("diff"), F.max("cluster_id").alias("cluster_id"))
            .where("diff is not null"))


def newest(rows: DataFrame, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.col("entry_s").desc(), F.col(tie).desc()).limit(n)


def gate(diffs: DataFrame, by: list[str], min_n: int = 200, alpha: float = 0.05, replicates: int = 2000,
         age_days: int | None = None, min_category_n: int | None = None) -> DataFrame:
    """Promote when the sequence's lower bound is above zero on enough clusters.

    `age_days` and `min_category_n` are given for the one challenger kind with
    a probation: 90 days and 200 rows in its smallest category.
    """
    clusters = diffs.groupBy(*by, "cluster_id").agg(F.avg("diff").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("diff").alias("s"))
    cells = clusters.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_clusters"), (F.sum("s") / F.sum("n")).alias("skill"), F.avg("m").alias("__mean"),
        F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("__var"))
    seq = E.sequence_columns(cells, "__mean", "__var", "n_clusters", alpha).drop("__mean", "__var", "cs_center", "cs_covers_zero")
    ci = E.resample(clusters.select(*by, "cluster_id", "n", "s"), by, replicates)
    probation = age_days is not None and (age_days < 90 or (min_category_n or 0) < 200)
    reason = (F.when(F.lit(probation), "probation").when(F.col("n_clusters") < min_n, "insufficient_n")
              .when(F.col("cs_lo") > 0, "better").otherwise("not_better"))
    return (seq.join(ci, by, "left").withColumn("reason", reason)
            .withColumn("promoted", (F.col("reason") == "better").cast("int")))


def rollback_check(diffs: DataFrame, by: list[str], alpha: float = 0.05, replicates: int = 2000) -> DataFrame:
    """`diffs` = active Brier minus previous Brier on the newest rows: better means degraded."""
    return (gate(diffs, by, min_n=2, alpha=alpha, replicates=replicates)
            .withColumnRenamed("promoted", "degraded").drop("reason"))
