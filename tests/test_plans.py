"""Plans must not pair everything with everything, and hot keys must not change results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from augurmill.operators import estimators as E
from augurmill.operators import scoring
from augurmill.oracle.compare import _key

QUERIES = entry.queries()


@pytest.mark.parametrize("name", ["quote_asof", "drift", "gap_windows", "gap_overlap", "verify_records", "eval_matrix", "bucketed_events",
                                  "bootstrap_ci", "stratified_ci", "taker_rate", "net_growth", "pair_candidates", "keyword_match", "m4_pool", "due_filter",
                                  "pair_correlation", "daily_digest", "exclude_windows", "window_members"])
def test_no_nested_loops_even_without_broadcasts(spark, sf, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_cluster_and_cell(spark):
    """A third of the rows in one cluster of one cell, in any partitioning: the same numbers."""
    n = 3000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 200)).alias("cluster_id"),
        F.when(F.col("id") % 3 == 1, "m2").otherwise("m1").alias("model_id"), F.col("id").cast("string").alias("forecast_id"),
        (F.col("id") % 50).alias("entry_s"), ((F.col("id") * 37 % 97 + 1) / 99).alias("p_yes"), ((F.col("id") * 31 % 97 + 1) / 99).alias("p_market_at_ts"),
        (F.col("id") % 2).cast("double").alias("payout_yes"))
    for op in (lambda d: E.paired_skill(d, ["model_id"]), lambda d: E.confidence_path(d, ["model_id"]),
               lambda d: E.bootstrap_ci(d, ["model_id"], 50), lambda d: E.stratified_ci(d, ["model_id"], 50)):
        results = [sorted(tuple(_key(round(v, 8) if isinstance(v, float) else v) for v in r) for r in op(base.repartition(k)).collect()) for k in (1, 9)]
        assert results[0] == results[1] and results[0]


def test_exclusion_ranges_are_inclusive(spark):
    f = spark.createDataFrame([("kalshi", 10 * 86400), ("kalshi", 12 * 86400 + 86399), ("kalshi", 13 * 86400), (None, 11 * 86400)], "venue string, ts_s bigint")
    assert scoring.exclude_windows(f, "kalshi", [(10, 12)]).count() == 2


def test_every_query_has_a_twin():
    """The queries of the plans; those of the optional part are tested where it is."""
    own = {name for name, run in QUERIES.items() if run.__module__.startswith("augurmill.plans")}
    assert len(own) > 130 and own <= set(entry.oracle_sql())


def test_matrix_shuffles_its_rows_once_and_makes_no_row_per_cell(spark, sf):
    """Rows that the joins placed by market are numbered and added up there; then one shuffle by cluster, one of the cells' parts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["eval_matrix"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = [line for line in plan.splitlines() if "hashpartitioning(forecast_id" in line or "Generate explode" in line]
    assert not rows and plan.count("hashpartitioning(model_id") == 2


def test_evidence_texts_are_read_once(spark, sf):
    """A list or an object: two readers in the plan, one of them for each text, however often the items are used."""
    plan = QUERIES["evidence_etl"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 2


def test_candidate_pairs_make_no_row_per_token(spark, sf):
    """Tokens are ordered where a set is read; a shuffle holds tokens of the smaller side's prefixes only."""
    from augurmill.operators import text
    sets = [f"a{i} b{i} c{i} d{i}" for i in range(50)]
    one = spark.createDataFrame([(i, "x", t) for i, t in enumerate(sets[:2])], "a_id int, block string, text string")
    two = spark.createDataFrame([(i, "x", t) for i, t in enumerate(sets)], "b_id int, block string, text string")
    known = spark.createDataFrame([], "a_id int, b_id int")
    got = text.pair_candidates(one, two, known, 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(0, 0), (1, 1)]
    assert "Window" not in plan and "explode" not in plan
    ha = text.hashed(text.token_sets(one, "a_id", "text"))
    own = spark.sparkContext.broadcast(text.token_counts(ha))
    assert text.set_prefixes(text.hashed(text.token_sets(two, "b_id", "text")), own, 0.5, "b", own).count() < 50
