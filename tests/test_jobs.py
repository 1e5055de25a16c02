"""Archive, ledger, audit, accounting, fits, graph and streams on small literal or random data."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.functions import weights as W
from augurmill.operators import accounting, audit, fits, health, text, universe
from augurmill.sources import archive, landing
from augurmill.sources import ledger as L
from augurmill.streaming import jobs

QUOTE = "quote_id string, condition_id string, ts_s bigint, mid double"


def test_first_write_wins_over_random_appends(spark, tmp_path):
    rng = np.random.default_rng(1)
    path, seen = str(tmp_path / "a"), {}
    for step in range(4):
        batch = [(f"{step}-{i:03d}", f"s{rng.integers(4)}", int(rng.integers(6)) * 40_000, float(rng.uniform())) for i in range(40)]
        for q, c, t, m in batch:
            seen.setdefault((c, t), q)
        archive.snapshot_append(spark.createDataFrame(batch, QUOTE), path)
        archive.snapshot_append(spark.createDataFrame(batch, QUOTE), path)
    got = archive.snapshot_read(spark, path).collect()
    assert {(r["condition_id"], r["ts_s"]): r["quote_id"] for r in got} == seen and len(got) == len(seen)


def test_archive_scan_prunes_dates_and_columns(spark, tmp_path):
    path = str(tmp_path / "a")
    data = [("1", "s", 0, 0.1), ("2", "s", 86400, 0.2), ("3", "t", 172800, 0.3)]
    df = spark.createDataFrame(data, QUOTE).withColumn("bids", F.expr("array(struct(0.1D as price, 5.0D as size))"))
    archive.snapshot_append(df, path)
    read = archive.snapshot_read(spark, path, dates=["1970-01-02"], columns=["condition_id", "mid", "open_interest"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "bids" not in plan.split("ReadSchema")[1]
    assert [tuple(r) for r in read.collect()] == [("s", 0.2, None)]


def test_ts_bucket_above_an_hour(spark):
    r = spark.range(1).select(archive.ts_bucket_column(F.lit(86400 + 5 * 3600 + 3599), 240).alias("a"),
                              archive.ts_bucket_column(F.lit(3600 + 59), 5).alias("b")).first()
    assert r["a"] == 86400 + 4 * 3600 and r["b"] == 3600


def test_forecast_append_twice_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", 10, "c", "m", 0.5, 0.5), ("b", 10, "c", "m", 1.0, 0.5), ("d", 10, None, "m", 0.5, 0.5)],
                                 "forecast_id string, ts_s bigint, condition_id string, model_id string, p_yes double, p_market_at_ts double")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    L.forecast_append(rows, good, bad)
    L.forecast_append(rows, good, bad)
    assert spark.read.parquet(good).count() == 1
    assert {r["reject_reason"] for r in spark.read.parquet(bad).collect()} == {"p_out_of_range", "missing_key"}


def test_export_writes_gzip_json_with_nulls(spark, tmp_path):
    L.write_json(spark.createDataFrame([("a", None)], "x string, y double"), str(tmp_path / "e"))
    assert list((tmp_path / "e").glob("*.json.gz"))
    assert spark.read.json(str(tmp_path / "e")).columns == ["x", "y"]


# ---------------------------------------------------------------- audit

def small_ledger(spark):
    return spark.createDataFrame([(i, f"c{i % 7}", 86400 * (i // 40) + i) for i in range(200)], "forecast_id bigint, condition_id string, ts_s bigint")


COLS = ["forecast_id", "condition_id", "ts_s"]


def records_of(spark, led):
    return audit.day_digests(led, "forecast_id", COLS).withColumn("record_id", F.col("day"))


def test_digest_does_not_depend_on_partitioning(spark):
    a = records_of(spark, small_ledger(spark)).orderBy("day").collect()
    b = records_of(spark, small_ledger(spark).repartition(13)).orderBy("day").collect()
    assert a == b and len(a) == 5


def test_tampering_and_superseded_records(spark):
    led = small_ledger(spark)
    recs = records_of(spark, led)
    double = recs.where("day = 2").withColumn("record_id", F.lit(99).cast("long")).withColumn("first_id", F.col("first_id") + 1)
    recs = recs.unionByName(double)
    tampered = led.withColumn("condition_id", F.when(F.col("forecast_id") == 41, "x").otherwise(F.col("condition_id")))
    got = {r["day"]: (r["verified"], r["superseded"]) for r in audit.verified_days(audit.verify_records(tampered, recs, "forecast_id", COLS)).collect()}
    assert got == {0: (1, 0), 1: (0, 0), 2: (1, 1), 3: (1, 0), 4: (1, 0)}


def test_empty_day_holds_only_while_empty(spark):
    led = small_ledger(spark)
    rec = audit.daily_digest(led, spark.range(0, 5).select(F.col("id").alias("day")), "forecast_id", COLS, 0, 7, 1).withColumn("record_id", F.col("day"))
    assert {(r["day"], r["row_count"], r["sha256"]) for r in rec.collect()} == {(5, 0, audit.EMPTY), (6, 0, audit.EMPTY)}
    late = led.unionByName(spark.createDataFrame([(900, "c", 5 * 86400)], led.schema))
    got = {r["day"]: r["ok"] for r in audit.verify_records(late, rec, "forecast_id", COLS).collect()}
    assert got == {5: False, 6: True}


# ---------------------------------------------------------------- accounting

def scored(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    data = [(f"f{i:04d}", "m", "hot" if i % 3 else None, f"c{i}", None, int(rng.integers(50)), int(rng.integers(50)),
             float(rng.uniform(0.05, 0.95)), float(rng.uniform(0.05, 0.95)), float(rng.integers(2))) for i in range(n)]
    return spark.createDataFrame(data, "forecast_id string, model_id string, category string, condition_id string, event_id string, "
                                       "entry_s bigint, ts_s bigint, p_yes double, p_market_at_ts double, payout_yes double")


def test_wealth_second_run_adds_nothing_and_carries_on(spark):
    rows = scored(spark)
    once = {r["forecast_id"]: (r["n_forecasts"], r["cum_log_wealth"]) for r in accounting.wealth_ledger(rows).collect()}
    first = accounting.wealth_ledger(rows.where("entry_s < 25")).persist()
    second = accounting.wealth_ledger(rows, first)
    both = {r["forecast_id"]: (r["n_forecasts"], r["cum_log_wealth"]) for r in first.unionByName(second).collect()}
    assert both.keys() == once.keys()
    for k, (n, c) in once.items():
        assert both[k][0] == n and both[k][1] == pytest.approx(c, abs=1e-12)
    assert accounting.wealth_ledger(rows, first.unionByName(second)).count() == 0


def test_kelly_by_hand(spark):
    r = accounting.kelly_delta(spark.createDataFrame([(0.7, 0.5, 1.0), (0.5, 0.5, 1.0), (0.3, 0.5, 1.0)],
                                                     "p_yes double, p_market_at_ts double, payout_yes double")).collect()
    assert r[0]["kelly"] == pytest.approx(0.05) and r[0]["log_wealth_delta"] == pytest.approx(math.log(1 - 0.05 + 0.05 / 0.5))
    assert r[1]["kelly"] == 0 and r[1]["log_wealth_delta"] == 0
    assert r[2]["side"] == "NO" and r[2]["log_wealth_delta"] == pytest.approx(math.log(0.95))


@pytest.mark.parametrize("fold_rows", [3, 50, 100_000])
def test_exposure_admit_equals_one_long_fold(spark, fold_rows):
    rng = np.random.default_rng(7)
    data = [("hot" if i % 3 else f"k{i % 5}", int(rng.integers(200)), f"t{i:04d}", float(rng.integers(1, 400))) for i in range(600)]
    used = {"hot": 300.0, "k1": 1999.0}
    want = set()
    for c, s, t, x in sorted(data):
        if used.get(c, 0.0) + x <= 2000:
            used[c] = used.get(c, 0.0) + x
            want.add(t)
    got = accounting.exposure_admit(
        spark.createDataFrame(data, "category string, seq bigint, trade_id string, stake double"),
        spark.createDataFrame([("hot", 300.0), ("k1", 1999.0)], "category string, exposure double"), fold_rows=fold_rows)
    assert {r["trade_id"] for r in got.collect()} == want


def test_wealth_bands_over_ranges_of_hashes(spark, monkeypatch):
    """Several ranges, blocks and a cell of one row: the quantiles of paths ordered in memory; no row per draw in the plan."""
    monkeypatch.setattr(accounting, "SLICE_DRAWS", 900)
    monkeypatch.setattr(accounting, "STEP_BLOCK", 70)
    data = [("m1" if i % 3 else "m2", "c", f"f{i}", (i * 37 % 101 - 50) / 1000) for i in range(500)] + [("m3", "c", "only", 0.5)]
    got = accounting.wealth_bands(spark.createDataFrame(data, "model_id string, category string, forecast_id string, log_wealth_delta double"), ["model_id", "category"], 9, 4)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for m in ("m1", "m2", "m3"):
        own = [(f, x) for model, _, f, x in data if model == m]
        paths = [np.cumsum([x for _, x in sorted(own, key=lambda r: hashlib.sha256(f"4|{rep}|{r[0]}".encode()).hexdigest())]) for rep in range(1, 10)]
        for step, (lo, hi) in enumerate(np.quantile(paths, [0.05, 0.95], axis=0).T, 1):
            want[m, step] = (pytest.approx(lo), pytest.approx(hi))
    assert {(r["model_id"], r["step"]): (r["lo"], r["hi"]) for r in got.collect()} == want


def test_registered_wealth_bands_take_500_replicates_and_hash_each_draw_once(spark, sf):
    """The largest cell against paths ordered in memory; counts and paths read the same shuffled draws."""
    from augurmill.plans import accounting as plans
    deltas = accounting.kelly_delta(plans.S.scored(spark, sf)).where("model_id = 'm0_market' and category = 'sports'")
    data = [(r.forecast_id, r.log_wealth_delta) for r in deltas.select("forecast_id", "log_wealth_delta").collect()]
    paths = [np.cumsum([x for _, x in sorted(data, key=lambda r: hashlib.sha256(f"3|{rep}|{r[0]}".encode()).hexdigest())]) for rep in range(1, 501)]
    query = plans.wealth_bands(spark, sf)
    got = {r.step: (r.lo, r.hi) for r in query.collect() if (r.model_id, r.category) == ("m0_market", "sports")}
    assert len(data) > 50 and len(got) == len(data)
    for step, (lo, hi) in enumerate(np.quantile(paths, [0.05, 0.95], axis=0).T, 1):
        assert got[step] == (pytest.approx(lo, abs=1e-6), pytest.approx(hi, abs=1e-6))
    final = query._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow pieces") == 1 and "ReusedExchange" in final


def test_no_category_is_brought_into_one_task_to_learn_its_state(spark):
    """The states go to the candidates, whatever the planner knows of sizes."""
    c = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 3).alias("category"), F.col("id").alias("seq"), F.col("id").cast("string").alias("trade_id"), F.lit(30.0).alias("stake"))
    plans = []
    real = accounting.cut
    accounting.cut = lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d)
    try:
        got = accounting.exposure_admit(c, spark.createDataFrame([("k1", 1910.0)], "category string, exposure double"), fold_rows=20)
        assert got.groupBy("category").count().orderBy("category").collect() == [("k0", 66), ("k1", 3), ("k2", 66)]
    finally:
        accounting.cut = real
    assert len(plans) > 3 and all("strategy=broadcast" in p for p in plans[1:])


@pytest.mark.parametrize("n", [0, 1, 997])
def test_deepest_drawdown_over_ranges(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n)
    path = np.concatenate([[0.0], np.cumsum(x)])
    rows = spark.createDataFrame([(i // 5, f"{i:04d}", float(v)) for i, v in enumerate(x)], "exit_s long, trade_id string, pnl double").repartition(3)
    got = accounting.deepest_drawdown(rows, ["exit_s", "trade_id"], "pnl")
    assert got.first()[0] == pytest.approx((path - np.maximum.accumulate(path)).min())


def test_first_loss_is_a_drawdown(spark):
    done = spark.createDataFrame([("1", 1, -5.0, 0.0), ("2", 2, 3.0, 0.0), ("3", 3, -1.0, 0.0)], "trade_id string, exit_s bigint, pnl double, fee double")
    none = spark.createDataFrame([], "condition_id string, token_side string, stake double, entry_price double")
    r = accounting.trade_summary(done, none, spark.createDataFrame([], "condition_id string, mid double")).first()
    assert r["max_drawdown"] == -5.0 and r["hit_rate"] == pytest.approx(1 / 3) and r["open_trades"] == 0


# ---------------------------------------------------------------- weights and fits

def weights_of(frame) -> dict:
    return {r["model_id"]: r["weight"] for r in frame.collect()}


def test_weight_bounds(spark):
    def pool(raw, links=None):
        rows = [("c", m, float(x), links) for m, x in zip("abcdef", raw)]
        return spark.createDataFrame(rows, "category string, model_id string, raw double, links array<string>")

    assert weights_of(W.bound_weights(pool([0.9, 0.05, 0.05]))) == pytest.approx({"a": 0.6, "b": 0.2, "c": 0.2}, abs=1e-9)
    # the floor lifts b, then what a gives up goes to the others in proportion
    assert weights_of(W.bound_weights(pool([0.97, 0.001, 0.029]))) == pytest.approx({"a": 0.6, "b": 0.4 * 20 / 49, "c": 0.4 * 29 / 49}, abs=1e-9)
    # nothing is above the ceiling: the floor of c is paid in proportion
    assert weights_of(W.bound_weights(pool([0.55, 0.445, 0.005]))) == pytest.approx({"a": 0.98 * 55 / 99.5, "b": 0.98 * 44.5 / 99.5, "c": 0.02}, abs=1e-9)
    assert weights_of(W.bound_weights(pool([1.0]))) == {"a": 0.6}
    shared = weights_of(W.bound_weights_by_group(pool([0.5, 0.4, 0.1], ["a|b", "b|absent"])))
    assert shared == pytest.approx({"a": 0.6 * 5 / 9, "b": 0.6 * 4 / 9, "c": 0.4}, abs=1e-9)
    # a member's floor inside a group at its ceiling is paid by the group alone
    tight = weights_of(W.bound_weights_by_group(pool([0.799, 0.001, 0.2], ["a|b"])))
    assert tight == pytest.approx({"a": 0.58, "b": 0.02, "c": 0.4}, abs=1e-9)
    chain = weights_of(W.bound_weights_by_group(pool([0.7, 0.1, 0.1, 0.1], ["c|d", "b|c", "a|b"])))
    assert chain == {m: 0.25 for m in "abcd"}


def test_duplicated_source_has_no_extra_weight(spark):
    r = spark.range(1).select(X.discounted_exponent(F.lit(2.5), F.lit(4), F.lit(1.0)).alias("same"),
                              X.discounted_exponent(F.lit(2.5), F.lit(4), F.lit(0.0)).alias("free"),
                              X.discounted_exponent(F.lit(1.0), F.lit(4), F.lit(0.3)).alias("one")).first()
    assert r["same"] == 1.0 and r["free"] == 2.5 and r["one"] == 1.0


def observations(spark, n=6000):
    rng = np.random.default_rng(11)
    p = rng.uniform(0.03, 0.97, n)
    v = rng.choice(["polymarket", "kalshi", "metaculus", "manifold"], n, p=[0.6, 0.35, 0.04, 0.01])
    shift = np.where(v == "kalshi", 0.5, 0.0)
    z = 0.3 + shift + 1.4 * np.log(p / (1 - p))
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(float)
    data = [(float(a), float(b), float(d), str(c)) for a, b, d, c in zip(p, y, rng.choice([3.0, 40.0], n), v)]
    return spark.createDataFrame(data, "p_market double, outcome double, days_to_resolution double, venue string"), data


def gradient(data, bucket, alpha, beta):
    lo, hi = {"lt7d": (0, 7), "30to90d": (30, 90)}[bucket]
    rows = [(math.log(p / (1 - p)), y) for p, y, d, _ in data if lo <= d < hi]
    r = [(y - 1 / (1 + math.exp(-(alpha + beta * x))), x) for x, y in rows]
    return abs(sum(e for e, _ in r)), abs(sum(e * x for e, x in r))


def test_recalibration_is_at_the_optimum(spark):
    obs, data = observations(spark)
    got = fits.fit_recalibration(obs).collect()
    assert {r["bucket"] for r in got} == {"lt7d", "30to90d"}
    for r in got:
        assert max(gradient(data, r["bucket"], r["alpha"], r["beta"])) < 1e-6
        assert r["beta"] == pytest.approx(1.4, abs=0.15)


def test_steps_of_a_fit_read_prices_and_not_rows(spark):
    obs, _ = observations(spark, 600)
    many = obs.crossJoin(spark.range(20)).drop("id")
    assert fits._training(many).count() == fits._training(obs).count()
    for fit in (fits.fit_recalibration, fits.fit_hier):
        one, all_ = ({(r["bucket"], r.asDict().get("venue")): r for r in fit(x).collect()} for x in (obs, many))
        for k, r in one.items():
            assert all_[k]["n"] == 20 * r["n"]
            if fit is fits.fit_recalibration:
                assert (all_[k]["alpha"], all_[k]["beta"]) == pytest.approx((r["alpha"], r["beta"]))


def test_bounded_steps_reads_the_ledger_once_for_all_fits(spark, sf):
    from augurmill.plans import fits as plans
    assert not any("lineitem" in f or "orders" in f for f in plans.bounded_steps(spark, sf).inputFiles())


def test_hierarchical_fit_minimizes_the_penalized_loss(spark):
    obs, data = observations(spark)
    got = fits.fit_hier(obs).collect()
    for bucket, (lo, hi) in {"lt7d": (0, 7), "30to90d": (30, 90)}.items():
        rows = [(math.log(p / (1 - p)), y, v) for p, y, d, v in data if lo <= d < hi and v != "manifold"]
        size = {v: sum(1 for r in rows if r[2] == v) for v in ("polymarket", "kalshi", "metaculus")}
        theta = {r["venue"]: (r["alpha"], r["beta"]) for r in got if r["bucket"] == bucket}
        assert set(theta) == {None, "polymarket", "kalshi", "metaculus"}

        def loss(t):
            total = sum(len(rows) / size[v] * (t[v][0] ** 2 + t[v][1] ** 2) for v in size)
            for x, y, v in rows:
                z = t[None][0] + t[v][0] + (t[None][1] + t[v][1]) * x
                total += math.log1p(math.exp(-z)) if y == 1 else math.log1p(math.exp(z))
            return total
        base = loss(theta)
        for v in theta:
            for i in (0, 1):
                for step in (-1e-3, 1e-3):
                    moved = dict(theta)
                    moved[v] = tuple(c + (step if j == i else 0) for j, c in enumerate(theta[v]))
                    assert loss(moved) > base
        assert abs(theta["metaculus"][0]) < abs(theta["kalshi"][0])


def test_isotonic_equals_pooling(spark):
    rng = np.random.default_rng(9)
    p = np.sort(rng.uniform(size=1000))
    y = (rng.uniform(size=1000) < p).astype(float)
    obs = spark.createDataFrame([(f"{i:04d}", float(a), float(b), 3.0) for i, (a, b) in enumerate(zip(p, y))],
                                "obs_id string, p_market double, outcome double, days_to_resolution double")
    curves = spark.createDataFrame([("lt7d", 0.0, 1.0)], "bucket string, alpha double, beta double")
    got = [r["isotonic"] for r in fits.isotonic_bins(obs, curves).orderBy("bin").collect()]
    blocks = []
    for part in np.array_split(y, 20):
        blocks.append([part.mean(), len(part), 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    assert got == pytest.approx([r for r, _, k in blocks for _ in range(k)], abs=1e-12)


def test_bounded_step(spark):
    r = spark.range(1).select(X.bounded(F.lit(2.0), F.lit(1.0)).alias("a"), X.bounded(F.lit(2.0), F.lit(0.0)).alias("b"),
                              X.bounded(F.lit(-2.0), F.lit(-1.0)).alias("c"), X.bounded(F.lit(2.0), F.lit(None).cast("double")).alias("d")).first()
    assert tuple(r) == (1.2, 2.0, -1.2, 2.0)


def test_normal_cdf(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(X.normal_cdf("z")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], abs=2e-7)


def test_mwu_of_fully_correlated_models_is_equal(spark):
    experts = spark.createDataFrame([("w", "m0_market", 0.1, 200), ("w", "m1_debiased", -0.1, 200)], "category string, model_id string, avg_log_wealth double, n_forecasts bigint")
    tied = spark.createDataFrame([("w", "m0_market", "m1_debiased", 0.9)], "category string, a string, b string, rho double")
    free = tied.withColumn("rho", F.lit(0.1))
    assert [r["weight"] for r in fits.mwu_weights(experts, tied).collect()] == [0.5, 0.5]
    raw = {r["model_id"]: r["raw"] for r in fits.mwu_weights(experts, free).collect()}
    eta = math.sqrt(8 * math.log(2) / 200)
    assert raw["m0_market"] == pytest.approx(1 / (1 + math.exp(-0.2 * eta)))


# ---------------------------------------------------------------- graph, text, landing, health

def test_event_link_of_chains_hubs_and_random_edges(spark):
    rng = np.random.default_rng(3)
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(90)] + [("hub", f"h{i}") for i in range(200)]
    edges += [(f"r{rng.integers(80)}", f"r{rng.integers(80)}") for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    known = spark.createDataFrame([("h7", "existing")], "condition_id string, event_id string")
    got = {r["condition_id"]: r["event_id"] for r in universe.event_link(spark.createDataFrame(edges, "a string, b string"), known).collect()}
    assert got.keys() == parent.keys() and got["hub"] == "existing"
    groups = {}
    for n, e in got.items():
        groups.setdefault(e, set()).add(find(n))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({find(n) for n in parent})


def brute_pairs(a, b, t):
    import regex
    sets = [{k: set(regex.findall(r"[\p{L}\p{N}]+", x.lower())) for k, x in side} for side in (a, b)]
    return {(i, j) for i, x in sets[0].items() for j, y in sets[1].items() if x and y and len(x & y) / len(x | y) >= t}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8])
def test_pair_candidates_are_exact(spark, t):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(25)]
    def texts(n):
        return [(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(n)]
    a, b = texts(40), texts(60)
    b += [(100 + i, a[0][1]) for i in range(20)]  # a block of copies
    schema = "{} bigint, block string, text string"
    got = text.pair_candidates(
        spark.createDataFrame([(i, "x", s) for i, s in a], schema.format("a_id")), spark.createDataFrame([(i, "x", s) for i, s in b], schema.format("b_id")),
        spark.createDataFrame([], "a_id bigint, b_id bigint"), t)
    pairs = [(r["a_id"], r["b_id"]) for r in got.collect()]
    assert set(pairs) == brute_pairs(a, b, t) and len(pairs) == len(set(pairs))


def test_keyword_match_of_a_common_word_equals_brute_force(spark):
    articles = [(i, "alpha common" if i % 3 else f"beta common {i}") for i in range(200)]
    markets = [("m1", "Will the alpha exceed beta?"), ("m2", "Is common sense in?"), ("m3", "Will the of")]
    got = text.keyword_match(spark.createDataFrame(articles, "article_id bigint, title string"),
                             spark.createDataFrame(markets, "condition_id string, question string"), 5)
    found = {}
    for r in got.collect():
        found.setdefault(r["condition_id"], []).append(r["article_id"])
    assert {k: sorted(v) for k, v in found.items()} == {"m1": [0, 1, 2, 3, 4], "m2": [0, 1, 2, 3, 4]}


ITEM = {"claim": "c", "direction": "for_yes", "strength": 2, "source_reliability": 3, "relevance": 0.5}


@pytest.mark.parametrize("body, n", [
    (json.dumps([ITEM]), 1), (json.dumps({"evidence": [ITEM, ITEM]}), 2), ("```json\n" + json.dumps([ITEM]) + "\n```", 1), ("[]", 0),
    (json.dumps([ITEM, {**ITEM, "strength": 4}]), None), (json.dumps([{**ITEM, "direction": "up"}]), None), (json.dumps([{**ITEM, "relevance": 1.5}]), None),
    (json.dumps({"other": [ITEM]}), None), ("not json", None), (json.dumps([ITEM]) + "x", None), (json.dumps([{k: v for k, v in ITEM.items() if k != "claim"}]), None)])
def test_evidence_schema_is_strict(spark, body, n):
    r = text.evidence_etl(spark.createDataFrame([(body,)], "text string")).first()
    assert (len(r["items"]) if r["items"] is not None else None) == n


def test_two_bid_book_is_inverted(spark):
    payload = {"market": {"yes_bid_dollars": "0.40", "yes_ask_dollars": "0.44", "yes_bid_size_fp": "0", "yes_ask_size_fp": "50"},
               "orderbook_fp": {"yes_dollars": [["0.39", "5"], ["0.40", "10"]], "no_dollars": [["0.56", "7"], ["0.50", "-1"]]}}
    r = landing.quote_etl(spark.createDataFrame([("kalshi", "k", 0, json.dumps(payload))], "venue string, condition_id string, ts_s bigint, payload string")).first()
    assert r["mid"] == pytest.approx(0.42) and r["bid_depth_usd"] is None and r["ask_depth_usd"] == pytest.approx(22.0)
    assert [x["price"] for x in r["bids"]] == [0.40, 0.39] and [round(x["price"], 2) for x in r["asks"]] == [0.44]


@pytest.mark.parametrize("spelling, ok", [("2026-09-14T13:35:38.40392Z", True), ("2026-09-14 13:35:38+00", True), ("2026-09-14 13:35:38.320219+00:00:00", True),
                                          ("2026-09-14 13:35:38+05:30", False), ("2026-09-14", False), ("soon", False), ("2026-13-41T99:00:00Z", False)])
def test_venue_timestamps(spark, spelling, ok):
    r = spark.createDataFrame([(spelling,)], "t string").select(X.venue_ts("t").alias("s")).first()
    assert (r["s"] == 1789392938) if ok else (r["s"] is None)


def test_coverage_counts_a_missing_target_day_as_zero(spark):
    data = [("m", "v", 86400 * d + i) for d in range(1, 6) for i in range(30)] + [("m6_consistency", "v", 86400 * d + i) for d in range(1, 6) for i in range(30)]
    f = spark.createDataFrame(data, "model_id string, venue string, ts_s bigint")
    got = health.coverage_drop(f, 6).collect()
    assert [(r["model_id"], r["n"], r["baseline"]) for r in got] == [("m", 0, 30.0)]
    assert health.coverage_drop(f, 5).count() == 0


def test_gap_overlap_is_strict(spark):
    gaps = spark.createDataFrame([(1000, 1300)], "gap_start_s bigint, gap_end_s bigint")
    f = spark.createDataFrame([("before", 0, 1000), ("after", 1300, 90_000), ("inside", 1100, 1200), ("around", 0, 200_000)], "id string, a bigint, b bigint")
    assert {r["id"]: r["in_gap"] for r in health.overlaps_gap(f, gaps, "a", "b").collect()} == {"before": False, "after": False, "inside": True, "around": True}


# ---------------------------------------------------------------- streams in several batches

def files(spark, df, path, parts):
    for i, piece in enumerate(df.randomSplit([1.0] * parts, 5)):
        piece.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def quotes(spark):
    return spark.createDataFrame([(f"{i:04d}", f"s{i % 5}", (i * 37) % 9000, float(i)) for i in range(300)], QUOTE)


def test_latest_stream_over_batches_equals_batch(spark, tmp_path):
    q = quotes(spark)
    jobs.stream_latest(files(spark, q, str(tmp_path / "in"), 3), str(tmp_path / "out"), str(tmp_path / "ck"), 4).awaitTermination()
    got = {tuple(r) for r in jobs.latest(spark, str(tmp_path / "out"), 4).read().select("condition_id", "ts_s", "mid").collect()}
    assert got == {tuple(r) for r in universe.latest_quote(q).select("condition_id", "ts_s", "mid").collect()}


def test_a_batch_touches_its_own_buckets_only_and_may_be_replayed(spark, tmp_path):
    table = jobs.latest(spark, str(tmp_path / "t"), 8)
    row = lambda i, ts, mid: (f"m{i}", ts, f"{ts:03d}", mid)
    frame = lambda *rows: spark.createDataFrame(list(rows), jobs.LATEST)
    merge = lambda new, old: jobs.newest(new.unionByName(old))
    table.upsert(0, frame(*[row(i, 5, 0.5) for i in range(40)]), merge)
    stamps = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("bucket=*/*.parquet")}
    before, late = stamps(), frame(row(3, 9, 0.9), row(4, 1, 0.1))
    own = {f"bucket={k}" for k in table.touched(late)}
    table.upsert(1, late, merge)
    assert {f for f in before if not any(f"/{k}/" in f for k in own)} == {f for f in stamps() if before.get(f) == stamps()[f]}
    want = sorted([row(i, 5, 0.5) for i in range(40) if i != 3] + [row(3, 9, 0.9)])
    read = lambda: sorted(tuple(r) for r in table.read().collect())
    assert read() == want
    table.upsert(1, late, merge)  # the same batch again
    assert read() == want
    for f in (tmp_path / "t" / sorted(own)[0]).glob("*"):  # it broke off amid the replacement
        f.unlink()
    table.upsert(1, late, merge)
    assert read() == want


def test_snapshot_stream_holds_one_quote_per_bucket(spark, tmp_path):
    q = quotes(spark)
    jobs.stream_snapshots(files(spark, q, str(tmp_path / "in"), 3), 5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = archive.snapshot_read(spark, str(tmp_path / "out")).select("condition_id", "ts_s").collect()
    want = archive.ts_bucket(q, 5).select("condition_id", "ts_s").distinct().collect()
    assert sorted(got) == sorted(want)


def test_snapshot_stream_keeps_the_lowest_id_of_a_batch_wherever_it_lies(spark, tmp_path):
    """Not the quote that a task reads first; a later batch's lower id does not replace a written row."""
    batches = [[("b", "x", 10, 2.0), ("c", "x", 20, 3.0), ("a", "x", 200, 1.0), ("d", "y", 0, 4.0)], [("0", "x", 0, 5.0), ("a", "x", 200, 1.0), ("e", "y", 301, 6.0)]]
    for rows in batches:
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], QUOTE).schema).parquet(str(tmp_path / "in"))
        jobs.stream_snapshots(stream, 5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in archive.snapshot_read(spark, str(tmp_path / "out")).select("quote_id", "condition_id", "ts_s", "mid").collect())
    assert got == [("a", "x", 0, 1.0), ("d", "y", 0, 4.0), ("e", "y", 300, 6.0)]


def test_a_stream_batch_writes_few_files_for_each_hour(spark, tmp_path):
    """Not one for each task and hour."""
    q = spark.range(4000).select(F.col("id").cast("string").alias("quote_id"), F.concat(F.lit("c"), F.col("id") % 50).alias("condition_id"),
                                 (F.col("id") * 37 % 144_000).alias("ts_s"), F.lit(0.5).alias("mid"))
    jobs.stream_snapshots(files(spark, q, str(tmp_path / "in"), 1), 5, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 40 <= len(list((tmp_path / "out").glob("date=*/hour=*/*.parquet"))) <= 40 + tasks


def test_snapshot_state_expires_and_the_first_write_still_stands(spark, tmp_path):
    """The fourth batch repeats the first long after its state is gone; a late quote of an empty bucket still comes in."""
    batches = [[("a", "x", 100, 1.0)], [("b", "x", 5000, 2.0)], [("c", "y", 90_000, 3.0)], [("d", "x", 110, 4.0), ("e", "z", 7, 5.0), ("f", "x", 4990, 6.0)]]
    for rows in batches:
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], QUOTE).schema).parquet(str(tmp_path / "in"))
        run = jobs.stream_snapshots(stream, 5, str(tmp_path / "out"), str(tmp_path / "ck"), "0 seconds")
        run.awaitTermination()
    kept = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
    assert kept[-1]["numRowsTotal"] < 5 and sum(k["numRowsRemoved"] for k in kept) > 0
    got = sorted(tuple(r) for r in archive.snapshot_read(spark, str(tmp_path / "out")).select("quote_id", "condition_id", "ts_s").collect())
    assert got == [("a", "x", 0), ("b", "x", 4800), ("c", "y", 90_000), ("e", "z", 0)]


def test_coverage_stream_counts_late_and_open_buckets_by_tier(spark, tmp_path):
    markets = spark.createDataFrame([("x", "liquid"), ("y", "tail")], "condition_id string, tier string")
    batches = [[("a", "x", 10, 0.1), ("b", "y", 20, 0.1), ("c", "x", 4000, 0.1)], [("d", "x", 30, 0.1), ("e", "q", 3990, 0.1)], [("f", "y", 9000, 0.1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], QUOTE).schema).parquet(str(tmp_path / "in"))
        jobs.stream_coverage(stream, markets, 15, 3000, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.tier, r.bucket_s): (r.n, r.late, r.closed) for r in jobs.coverage(spark, str(tmp_path / "out"), 15, 3000).collect()}
    assert got == {("liquid", 0): (2, 1, True), ("tail", 0): (1, 0, True), ("liquid", 3600): (1, 0, True), ("unknown", 3600): (1, 0, True), ("tail", 9000): (1, 0, False)}
    assert jobs.coverage(spark, str(tmp_path / "none"), 15, 3000).count() == 0


def test_resolution_stream_over_batches(spark, tmp_path):
    rows = scored(spark, 90).withColumn("category", F.lit("w")).withColumn("end_s", F.lit(0).cast("long"))
    r = rows.select("condition_id", (F.col("entry_s") + 700_000).alias("resolved_s"), "payout_yes", F.lit(0).alias("disputed"),
                    F.lit(None).cast("long").alias("venue_resolved_s"))
    f = rows.drop("payout_yes", "entry_s").withColumn("ts_s", F.lit(1).cast("long"))
    paths = [str(tmp_path / n) for n in ("known", "wealth", "state", "ck")]
    jobs.stream_resolutions(files(spark, r, str(tmp_path / "in"), 3), f, 10_000_000, *paths[:3], paths[3]).awaitTermination()
    got = jobs.wealth_rows(spark, paths[1]).collect()
    assert len(got) == 90 and len({x["forecast_id"] for x in got}) == 90
    assert sorted(x["n_forecasts"] for x in got) == list(range(1, 91))
    total = accounting.kelly_delta(rows).agg(F.sum("log_wealth_delta")).first()[0]
    assert max(got, key=lambda x: x["n_forecasts"])["cum_log_wealth"] == pytest.approx(total, abs=1e-9)


def test_a_replayed_resolution_batch_adds_nothing(spark, tmp_path):
    """The commit of the last batch is lost: it runs again over its own outcomes, wealth and state."""
    rows = scored(spark, 60).withColumn("category", F.lit("w")).withColumn("end_s", F.lit(0).cast("long"))
    r = rows.select("condition_id", (F.col("entry_s") + 700_000).alias("resolved_s"), "payout_yes", F.lit(0).alias("disputed"),
                    F.lit(None).cast("long").alias("venue_resolved_s"))
    f = rows.drop("payout_yes", "entry_s").withColumn("ts_s", F.lit(1).cast("long"))
    known, wealth, state, ck = (str(tmp_path / n) for n in ("known", "wealth", "state", "ck"))
    stream = files(spark, r, str(tmp_path / "in"), 3)
    run = lambda: jobs.stream_resolutions(stream, f, 10_000_000, known, wealth, state, ck, 4).awaitTermination()
    run()
    read = lambda: (sorted(map(str, jobs.wealth_rows(spark, wealth).drop("batch").collect())), sorted(map(str, spark.read.parquet(state).collect())))
    before = read()
    for name in ("2", ".2.crc"):
        (tmp_path / "ck" / "commits" / name).unlink()
    run()
    assert read() == before


def test_bounded_steps_by_key_with_new_missing_and_zero_values(spark):
    new = spark.createDataFrame([("a", None, 2.0, 5.0), ("a", "v", 0.1, -3.0), ("b", "v", 9.0, 9.0), ("c", None, None, 1.0)], "bucket string, venue string, alpha double, beta double")
    old = spark.createDataFrame([("a", None, 1.0, 0.0), ("a", "v", 1.0, -1.0), ("c", None, 1.0, 1.1), ("z", "v", 1.0, 1.0)], new.schema)
    got = sorted(map(tuple, fits.bounded_step(new, old, ["bucket", "venue"], ["alpha", "beta"]).collect()), key=str)
    want = [("a", "v", 0.8, -1.2), ("a", None, 1.2, 5.0), ("b", "v", 9.0, 9.0), ("c", None, None, 1.0)]
    assert got == [(b, v, pytest.approx(x) if x is not None else None, pytest.approx(y)) for b, v, x, y in want]


def test_ledger_rows_come_to_the_forecasts_place(spark):
    f = spark.range(400).select(F.concat(F.lit("m"), F.col("id") % 40).alias("condition_id"), F.col("id").cast("string").alias("forecast_id")).repartition("condition_id").persist()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f.count()
        left = lambda: f.join(f.where("forecast_id < 3").withColumn("condition_id", F.concat("condition_id", F.lit(""))), ["condition_id", "forecast_id"], "left_anti")
        shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        plain = shuffles(left())
        with jobs.placed_by_some_keys(spark):
            near = left()
            assert shuffles(near) == plain - 1 and near.count() == 397
        assert shuffles(left()) == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        f.unpersist()


def test_expert_sums_are_the_ledgers_last_state(spark, sf):
    from augurmill.plans import scoring as S
    import __spark_entry__ as entry
    rows = S.scored(spark, sf)
    state = {(r["model_id"], r["category"]): r for r in accounting.expert_state(accounting.wealth_ledger(rows)).collect()}
    sums = accounting.expert_sums(rows).collect()
    assert len(sums) == len(state) > 10
    for r in sums:
        s = state[r["model_id"], r["category"]]
        assert (r["n_forecasts"], r["cum_log_wealth"]) == (s["n_forecasts"], pytest.approx(s["cum_log_wealth"], abs=1e-9))
    assert not any("slices" in x for x in entry.queries()["mwu_weights"](spark, sf).inputFiles())


def test_replayed_weights_read_the_forecasts_once(spark, sf):
    import __spark_entry__ as entry
    from augurmill.plans import fits as PF
    entry.queries()
    rows = PF.weight_versions(spark, sf)
    assert not any("lineitem" in x for x in rows.inputFiles())
    assert {r["version"] for r in rows.select("version").distinct().collect()} == {"old", "new"}
