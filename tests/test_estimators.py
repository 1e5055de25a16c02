import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurmill.functions.prefix import running
from augurmill.operators import estimators as E
from augurmill.operators import scoring

DAY = 86400


def scored(spark, data):
    return spark.createDataFrame(data, "model_id string, cluster_id string, forecast_id string, entry_s bigint, p_yes double, "
                                       "p_market_at_ts double, payout_yes double")


def random_rows(n=400, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    p, q = rng.uniform(0.02, 0.98, n), rng.uniform(0.02, 0.98, n)
    y = (rng.uniform(size=n) < q).astype(float)
    return [("m", f"c{rng.integers(clusters):03d}", f"f{i}", int(rng.integers(1000)), float(a), float(b), float(c))
            for i, (a, b, c) in enumerate(zip(p, q, y))]


def diffs_by_cluster(data):
    out = {}
    for _, c, _, entry, p, q, y in data:
        out.setdefault(c, []).append(((q - y) ** 2 - (p - y) ** 2, entry))
    return out


def test_paired_skill_by_hand(spark):
    r = E.paired_skill(scored(spark, [("m", "a", "1", 0, 0.8, 0.6, 1.0), ("m", "b", "2", 0, 0.3, 0.5, 0.0)]), ["model_id"]).first()
    assert r["brier_model"] == pytest.approx((0.04 + 0.09) / 2)
    assert r["brier_market"] == pytest.approx((0.16 + 0.25) / 2)
    assert r["skill"] == pytest.approx(0.14)
    assert r["log_loss_model"] == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)
    assert r["mde"] == pytest.approx(2.8 * np.std([0.12, 0.16], ddof=1) / math.sqrt(2))


def test_one_cluster_has_no_detectable_effect(spark):
    r = E.paired_skill(scored(spark, [("m", "a", "1", 0, 0.8, 0.6, 1.0)]), ["model_id"]).first()
    assert r["mde"] is None and r["n_clusters"] == 1


def radius(diffs, n_target, alpha=0.05):
    t = len(diffs)
    rho = n_target * E.rho_per_n(alpha)
    v = t * (np.var(diffs, ddof=1) if t > 1 else 0.0)
    return math.sqrt((v + rho) * math.log((v + rho) / (alpha ** 2 * rho))) / t


def test_rho_solves_the_branch_equation():
    w = -1 / E.rho_per_n(0.05) - 1
    assert w * math.exp(w) == pytest.approx(-0.05 ** 2 / math.e, rel=1e-12)


def test_confidence_path_matches_naive_prefixes(spark):
    data = random_rows()
    means = sorted((min(e for _, e in v), c, np.mean([d for d, _ in v])) for c, v in diffs_by_cluster(data).items())
    d = [m for _, _, m in means]
    got = E.confidence_path(scored(spark, data), ["model_id"]).orderBy("seq").collect()
    for t, r in enumerate(got, 1):
        half = radius(d[:t], len(d))
        assert r["cluster_id"] == means[t - 1][1]
        assert r["cs_lo"] == pytest.approx(np.mean(d[:t]) - half, abs=1e-9)
        assert r["cs_hi"] == pytest.approx(np.mean(d[:t]) + half, abs=1e-9)
    full = E.confidence_sequence(scored(spark, data), ["model_id"]).first()
    assert full["cs_lo"] == pytest.approx(got[-1]["cs_lo"], abs=1e-12)


def test_sequence_covers_zero_under_the_null(spark):
    rng = np.random.default_rng(5)
    data = [(f"run{k}", f"c{i:04d}", f"{k}-{i}", i, 0.5 + e, 0.5 - e, float(rng.integers(2)))
            for k in range(20) for i, e in enumerate(rng.choice([-0.1, 0.1], 200).tolist())]
    path = E.confidence_path(scored(spark, data), ["model_id"])
    missed = path.where("cs_lo > 0 or cs_hi < 0").select("model_id").distinct().count()
    assert missed <= 3


def test_wider_interval_for_events_than_for_rows(spark):
    rng = np.random.default_rng(2)
    shift = rng.normal(0, 0.2, 30)
    data = [("m", f"e{i % 30}", f"f{i}", 0, float(np.clip(0.5 + shift[i % 30], 0.01, 0.99)), 0.5, 1.0) for i in range(300)]
    grouped = E.bootstrap_ci(scored(spark, data), ["model_id"], 400).first()
    single = E.bootstrap_ci(scored(spark, [(m, f, f, e, p, q, y) for m, c, f, e, p, q, y in data]), ["model_id"], 400).first()
    assert grouped["ci_hi"] - grouped["ci_lo"] > 1.5 * (single["ci_hi"] - single["ci_lo"])


def numpy_interval(data, B=4000):
    groups = [np.array([d for d, _ in v]) for v in diffs_by_cluster(data).values()]
    rng, n = np.random.default_rng(0), np.array([len(g) for g in groups])
    s = np.array([g.sum() for g in groups])
    pick = rng.integers(len(groups), size=(B, len(groups)))
    return np.quantile(s[pick].sum(1) / n[pick].sum(1), [0.025, 0.975])


def test_intervals_agree_with_numpy(spark):
    data = random_rows(1200, 150)
    lo, hi = numpy_interval(data)
    width = hi - lo
    for ci in (E.bootstrap_ci(scored(spark, data), ["model_id"]).first(), E.bootstrap_ci_poisson(scored(spark, data), ["model_id"], seed=3).first()):
        assert abs(ci["ci_lo"] - lo) < 0.15 * width and abs(ci["ci_hi"] - hi) < 0.15 * width


def test_replicate_weights_are_poisson_and_unrelated(spark):
    """Mean and variance 1 over clusters and over replicates; no replicate, next or twice as far, resembles another."""
    clusters = spark.range(800).select(F.lit("m").alias("model_id"), F.concat(F.lit("c"), "id").alias("cluster_id"))
    rows = E._weights(clusters, ["model_id"], 300, 5).select(F.substring("cluster_id", 2, 9).cast("int").alias("c"), "rep", "w").toPandas()
    w = np.zeros((800, 300))
    w[rows["c"], rows["rep"] - 1] = rows["w"]
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    shares = np.bincount(w.astype(int).ravel(), minlength=5)[:5] / w.size
    assert np.abs(shares - np.exp(-1) / np.array([1, 1, 2, 6, 24])).max() < 0.005
    for table in (w, w.T):
        r = np.corrcoef(table)[np.triu_indices(len(table), 1)]
        assert abs(r.mean()) < 0.002 and np.abs(r).max() < 0.3 and abs(r.std() * np.sqrt(table.shape[1]) - 1) < 0.05


def test_sums_of_draws_make_no_row_per_draw(spark):
    """The tables of weights give the sums of the weights' rows, and no plan expands clusters by replicates."""
    clusters = spark.range(500).select(F.when(F.col("id") % 3 > 0, "m").alias("model_id"), (F.col("id") % 4).alias("stratum"), F.concat(F.lit("c"), F.col("id") % 250).alias("cluster_id"),
                                       F.lit(2).alias("n"), (F.col("id") / 7).alias("s"))
    w = F.col("w")
    want = E._weights(clusters, ["model_id"], 70, 5).groupBy("model_id", "stratum", "rep").agg(F.sum(w * F.col("n")).alias("n"), F.sum(w * F.col("s")).alias("s"))
    got = E.drawn_sums(clusters, ["model_id"], ["n", "s"], 70, 5, ["stratum"])
    plain = lambda d: sorted((str(r["model_id"]), r["stratum"], r["rep"], float(r["n"]), round(r["s"], 6)) for r in d.collect())
    assert plain(got) == plain(want)
    assert "Generate" not in E.bootstrap_ci(scored(spark, random_rows(60, 10)), ["model_id"])._jdf.queryExecution().executedPlan().toString()


def test_resampling_gathers_no_clusters(spark, sf):
    data = random_rows(60, 10)
    for op in (E.bootstrap_ci, E.stratified_ci):
        plan = op(scored(spark, data), ["model_id"])._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "Join" not in plan


def test_stratified_collapses_to_the_raw_mean_with_equal_variances(spark):
    data = [("m", f"{s}{i}", f"{s}{i}", 0, 0.5 + (0.1 if i % 2 else -0.1), q, 1.0)
            for s, q in enumerate((0.1, 0.3, 0.5)) for i in range(40 * (s + 1))]
    rows = scored(spark, data)
    base = {r["stratum"]: r["v"] for r in rows.groupBy(E.step_index(F.col("p_market_at_ts"), E.STRATA).alias("stratum"))
            .agg(F.var_pop(F.col("p_yes")).alias("v")).collect()}
    assert len(base) == 3
    got = E.stratified_skill(rows, ["model_id"]).first()
    by = {}
    for _, _, _, _, p, q, y in data:
        by.setdefault(q, []).append((q - y) ** 2 - (p - y) ** 2)
    w = {q: len(v) / np.var(v, ddof=1) for q, v in by.items()}
    want = sum(w[q] * np.mean(v) for q, v in by.items()) / sum(w.values())
    assert got["n_strata"] == 3 and got["skill_pw"] == pytest.approx(want, rel=1e-9)


def test_too_few_strata_give_nothing(spark):
    data = [("m", f"c{i}", f"f{i}", 0, 0.4, 0.5, 1.0) for i in range(100)]
    r = E.stratified_skill(scored(spark, data), ["model_id"]).first()
    assert r["skill_pw"] is None and r["n_strata"] == 1
    assert E.stratified_ci(scored(spark, data), ["model_id"], 50).first()["ci_lo"] is None


def test_calibration_keeps_empty_bins_and_closes_the_last(spark):
    data = [("m", "a", "1", 0, 0.30000000000000004, 0.5, 1.0), ("m", "a", "2", 0, 1.0, 0.5, 1.0), ("m", "a", "3", 0, 0.3, 0.5, 0.0)]
    bins = {r["bin"]: r["n"] for r in E.calibration_bins(scored(spark, data), ["model_id"]).collect()}
    assert bins == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 1}


def test_two_bucket_rps_is_brier(spark):
    legs = spark.createDataFrame([("m", "e", "ok", 2, 1.0, 0.3, 0.6, 1.0, 1.0, 1.0), ("m", "e", "ok", 2, 2.0, 0.7, 0.4, 0.0, 1.0, 1.0)],
                                 "model_id string, event_id string, verdict string, k int, order_value double, p_yes double, "
                                 "p_market_at_ts double, payout_yes double, sum_model double, sum_market double")
    r = E.rps(legs, ["model_id"]).first()
    assert r["rps_model"] == pytest.approx(0.49) and r["rps_market"] == pytest.approx(0.16)


def test_bucketed_events_take_the_latest_complete_pass(spark):
    legs = spark.createDataFrame([("e", "a", 0, 1.0), ("e", "b", 0, 2.0), ("e", "late", 150, 3.0)],
                                 "event_id string, condition_id string, first_seen_s bigint, order_value double")
    def row(ts, c, y):
        return ("m", "e", c, f"{ts}{c}", ts, 0.5, 0.5, y)
    data = [row(100, "a", 1.0), row(100, "b", 0.0), row(200, "a", 1.0), row(200, "b", 0.0), row(300, "late", 0.0)]
    f = spark.createDataFrame(data, "model_id string, event_id string, condition_id string, forecast_id string, ts_s bigint, "
                                    "p_yes double, p_market_at_ts double, payout_yes double")
    got = E.bucketed_events(f, legs, ["model_id"]).collect()
    assert {(r["ts_s"], r["condition_id"], r["verdict"]) for r in got} == {(100, "a", "ok"), (100, "b", "ok")}


def nearest(quotes, target, tol):
    best = [(abs(t - target), t, m) for t, m in quotes if abs(t - target) <= tol]
    return min(best)[1:] if best else None


def test_quote_asof_against_search(spark):
    rng = np.random.default_rng(3)
    quotes = {(f"s{rng.integers(5)}", int(t)) for t in rng.integers(0, 200_000, 300)}
    q = [(str(i), c, t, None if i % 9 == 0 else float(i)) for i, (c, t) in enumerate(sorted(quotes))]
    targets = [(f"s{rng.integers(6)}", int(t)) for t in rng.integers(-20_000, 220_000, 400)] + [(c, t) for _, c, t, _ in q[:40]]
    got = E.quote_asof(spark.createDataFrame(targets, "condition_id string, target_s bigint"),
                       spark.createDataFrame(q, "quote_id string, condition_id string, ts_s bigint, mid double")).collect()
    by = {}
    for _, c, t, m in q:
        by.setdefault(c, []).append((t, m))
    assert len(got) == len(targets)
    for r in got:
        want = nearest([(t, -1 if m is None else m) for t, m in by.get(r["condition_id"], [])], r["target_s"], 10800)
        if want is None:
            assert r["quote_s"] is None
        else:
            assert r["quote_s"] == want[0] and r["mid"] == (None if want[1] == -1 else want[1])


def test_tie_takes_the_earlier_quote(spark):
    q = spark.createDataFrame([("1", "s", 100, 0.1), ("2", "s", 300, 0.3)], "quote_id string, condition_id string, ts_s bigint, mid double")
    r = E.quote_asof(spark.createDataFrame([("s", 200)], "condition_id string, target_s bigint"), q).first()
    assert r["quote_s"] == 100


def ledger(spark, ts, end, resolved, disputed=0):
    f = spark.createDataFrame([("f", "c", None, end, "m", ts, 0.5, 0.5)], "forecast_id string, condition_id string, event_id string, "
                              "end_s bigint, model_id string, ts_s bigint, p_yes double, p_market_at_ts double")
    r = spark.createDataFrame([("c", resolved, 1.0, disputed)], "condition_id string, resolved_s bigint, payout_yes double, disputed int")
    return f, r


def test_early_resolution_waits_for_its_stated_end(spark):
    f, r = ledger(spark, 0, 100 * DAY, 5 * DAY)
    assert scoring.scored_rows(f, r, None, 106 * DAY).count() == 0
    row = scoring.scored_rows(f, r, None, 107 * DAY).first()
    assert row["entry_s"] == 107 * DAY and row["cluster_id"] == "c"
    assert scoring.scored_rows(f, r, None, 10 * DAY, censor=False).count() == 1


def test_no_stated_end_never_enters(spark):
    f, r = ledger(spark, 0, None, 5 * DAY)
    assert scoring.scored_rows(f, r, None, 10_000 * DAY).count() == 0


def test_as_of_runs_do_not_see_later_outcomes(spark):
    f, r = ledger(spark, 0, 10 * DAY, 50 * DAY)
    assert scoring.scored_rows(f, r, None, 40 * DAY).count() == 0
    assert scoring.scored_rows(f, r, None, 50 * DAY).count() == 1


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums_of_a_hot_key(spark, partitions):
    rng = np.random.default_rng(4)
    data = [("hot" if i % 3 else f"k{i % 50}", int(rng.integers(40)), f"{i:05d}", float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, t bigint, id string, v double").repartition(partitions)
    got = {r["id"]: r for r in running(df, ["k"], ["t", "id"], sums={"cum": F.col("v")}, maxes={"top": F.col("v")}, count="n").collect()}
    state = {}
    for k, t, i, v in sorted(data):
        s, m, n = state.get(k, (0.0, -9e9, 0))
        state[k] = (s + v, max(m, v), n + 1)
        assert got[i]["cum"] == pytest.approx(state[k][0], abs=1e-9)
        assert got[i]["top"] == state[k][1] and got[i]["n"] == state[k][2]


def test_running_lays_its_slices_down_as_a_compressed_table(spark):
    """No checkpoint of whole rows, and only what keys bring from slices before is joined to them."""
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id"))
    plan = running(df, ["k"], ["id"], sums={"s": F.col("id")})._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "parquet" in plan and "strategy=broadcast" in plan


def test_running_keeps_null_keys_together(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 3, 5.0)], "k string, t bigint, v double")
    got = {r["t"]: r["cum"] for r in running(df, ["k"], ["t"], sums={"cum": F.col("v")}).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 5.0}


def test_drift_is_judged_on_the_control_set_only(spark):
    """Drift follows skill outside of the control set, not in it."""
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", float(rng.normal()), float(rng.normal())) for i in range(200)] + [(f"x{i}", float(i), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "condition_id string, drift double, skill double")
    control = df.where("condition_id like 'c%'").select("condition_id")
    assert tuple(E.drift_trust(df, control).select("n", "reason", "trusted").first()) == (200, "checked", 1)
    assert tuple(E.drift_trust(df, df).select("n", "reason", "trusted").first()) == (400, "checked", 0)
    assert tuple(E.drift_trust(df, control.limit(0)).select("n", "reason", "trusted").first()) == (0, "no_control", 1)
    assert E.drift_trust(df.limit(0), control).first()["reason"] == "no_data"
