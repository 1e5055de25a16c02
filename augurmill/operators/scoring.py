"""Which ledger rows count, when, and in which cell of the evaluation."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurmill.functions import exprs as X

SCORING_LAG_DAYS = 7


def scored_rows(forecasts: DataFrame, resolutions: DataFrame, markets: DataFrame | None, as_of: int,
                include_disputed: bool = False, censor: bool = True) -> DataFrame:
    """Forecast rows with a usable outcome.

    A row enters once its market's *stated* end lies `SCORING_LAG_DAYS` before
    `as_of`; `entry_s` is the later of that moment and the recorded outcome. A
    row with no stated end never enters. `markets=None` says the ledger rows
    already carry their market columns, which saves a join.
    """
    f = forecasts
    if markets is not None:
        kept = ["condition_id"] + [c for c in markets.columns if c not in f.columns]
        f = f.join(markets.select(*kept), "condition_id")
    r = resolutions if include_disputed else resolutions.where("disputed = 0")
    rows = f.where(F.col("ts_s") <= as_of).join(r.where(F.col("resolved_s") <= as_of), "condition_id")
    stated = F.col("end_s")
    if "days_to_resolution_at_ts" in rows.columns:
        stated = F.coalesce(F.col("ts_s") + F.col("days_to_resolution_at_ts") * X.DAY, stated)
    due = stated + SCORING_LAG_DAYS * X.DAY
    if censor:
        rows = rows.where(due <= as_of)
    return (rows.withColumn("entry_s", X.greatest_strict(F.col("resolved_s"), due))
            .withColumn("cluster_id", X.cluster_key()))


def forward_only(forecasts: DataFrame, versions: DataFrame) -> DataFrame:
    """Only forecasts at or after the model's first registration, where it has one."""
    first = versions.groupBy("model_id").agg(F.min("registered_s").alias("first_registered_s"))
    return (forecasts.join(first, "model_id", "left")
            .where(F.col("first_registered_s").isNull() | (F.col("ts_s") >= F.col("first_registered_s")))
            .drop("first_registered_s"))


def exclude_windows(rows: DataFrame, venue: str, day_ranges: list[tuple[int, int]]) -> DataFrame:
    """Drop one venue's rows whose forecast day lies in an inclusive range.

    The ranges are declared constants, so they become one predicate.
    """
    day = X.day_of("ts_s")
    hit = F.lit(False)
    for lo, hi in day_ranges:
        hit = hit | day.between(lo, hi)
    return rows.where(~((X.venue_of() == venue) & hit))


def stated_horizon() -> Column:
    return X.horizon_bucket((F.col("end_s") - F.col("ts_s")) / X.DAY)


def realized_horizon(venue_time: bool = False) -> Column:
    """Resolution minus forecast; the venue's own time first where recorded."""
    resolved = F.coalesce(F.col("venue_resolved_s"), F.col("resolved_s")) if venue_time else F.col("resolved_s")
    return X.horizon_bucket((resolved - F.col("ts_s")) / X.DAY)


def horizon_bucket(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("stated_bucket", stated_horizon())
            .withColumn("realized_bucket", realized_horizon("venue_resolved_s" in rows.columns)))


def labels(pairs: list[tuple[str, Column]]) -> Column:
    """Array of the names whose predicate holds: a row's memberships."""
    tagged = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs])
    return F.array_compact(tagged)


def mask(pairs: list[tuple[str, Column]]) -> Column:
    """The same memberships as bits of one integer: a short grouping key."""
    out = F.lit(0)
    for i, (_, cond) in enumerate(pairs):
        out = out + F.when(F.coalesce(cond, F.lit(False)), F.lit(1 << i)).otherwise(0)
    return out


def windows(as_of: int, start: int) -> list[tuple[str, Column]]:
    ts = F.col("ts_s")
    return [
        ("all_time", ts <= as_of),
        ("trailing_90d", (ts >= as_of - 90 * X.DAY) & (ts <= as_of)),
        ("confirmatory", (ts >= start) & (ts <= as_of)),
    ]


def window_members(rows: DataFrame, as_of: int, start: int) -> DataFrame:
    return rows.withColumn("window_label", F.explode(labels(windows(as_of, start))))


# The family whose exclusive and non-exclusive groups are split.
RECALIBRATION_FAMILY = ("m1_debiased", "m1_hier@polymarket", "m1_hier@kalshi", "m1_hier@metaculus")
POOL_MODEL = "m7_crossvenue"


def variants(as_of: int, since: int, pool_since: int) -> list[tuple[str, Column]]:
    """Named row sets of the robustness checks, `primary` among them."""
    scoreable = (F.col("end_s") + SCORING_LAG_DAYS * X.DAY) <= as_of
    settled = F.col("disputed") == 0
    primary = scoreable & settled
    family = F.col("model_id").isin(*RECALIBRATION_FAMILY)
    return [
        ("primary", primary),
        ("disputed_inclusive", scoreable),
        ("dedup_daily", primary & F.col("first_of_day")),
        ("pre_end_date", primary & (F.col("end_s").isNull() | (F.col("ts_s") < F.col("end_s")))),
        ("since", primary & (F.col("ts_s") >= since)),
        ("pool_since", primary & (F.col("model_id") == POOL_MODEL) & (F.col("ts_s") >= pool_since)),
        ("negrisk", primary & family & (F.col("neg_risk") == 1)),
        ("non_negrisk", primary & family & (F.coalesce(F.col("neg_risk"), F.lit(0)) == 0)),
        ("uncensored", settled),
    ]


def flag_first_of_day(rows: DataFrame, as_of: int) -> DataFrame:
    """True on the first scoreable row per (market, model, UTC day).

    Rows that were joined by market lie together already, so numbering them moves none; a day's rows of one
    market and model are numbered as they are read, and not held.
    """
    counts = F.coalesce(((F.col("end_s") + SCORING_LAG_DAYS * X.DAY) <= as_of) & (F.col("disputed") == 0), F.lit(False))
    own = Window.partitionBy("condition_id", "model_id", X.day_of("ts_s")).orderBy((~counts).cast("int"), "ts_s", "forecast_id")
    return rows.withColumn("first_of_day", counts & (F.row_number().over(own) == 1))


def robustness_variants(rows: DataFrame, as_of: int, since: int, pool_since: int) -> DataFrame:
    """`rows` must hold disputed and uncensored rows too."""
    return (flag_first_of_day(rows, as_of)
            .withColumn("variant", F.explode(labels(variants(as_of, since, pool_since))))
            .drop("first_of_day"))


def eval_matrix(rows: DataFrame, control_ids: DataFrame, as_of: int, start: int,
                since: int, pool_since: int, alpha: float = 0.05) -> DataFrame:
    """Every cell of model x venue x {category, ALL} x window x horizon x variant.

    Rows first collapse to sums per market and membership signature (two
    bit masks), where the joins by market have put them, so a hot market arrives
    small. Those sums are placed by (model, venue, cluster), the only shuffle of them; summing
    per signature and per (cell, cluster) then needs no other, because every key contains that one.
    """
    from augurmill.operators.estimators import PAIRED_SUMS, sequence_columns

    in_window, in_variant = windows(as_of, start), variants(as_of, since, pool_since)
    control = control_ids.select("condition_id").distinct().withColumn("is_control", F.lit(True))
    flagged = (flag_first_of_day(rows, as_of)
               .join(control, "condition_id", "left")
               .withColumn("is_control", F.coalesce("is_control", F.lit(False)))
               .withColumn("window_bits", mask(in_window)).withColumn("variant_bits", mask(in_variant)))
    flagged = horizon_bucket(flagged).where("variant_bits > 0 and (window_bits > 0 or is_control)")

    signature = ["model_id", "venue", "cluster_id", "category", "is_control", "window_bits", "variant_bits",
                 "stated_bucket", "realized_bucket"]
    base = (flagged.groupBy("condition_id", *signature).agg(*[F.sum(F.expr(v)).alias(n) for n, v in PAIRED_SUMS.items()])
            .drop("condition_id").repartition("model_id", "venue", "cluster_id")
            .groupBy(*signature).agg(*[F.sum(n).alias(n) for n in PAIRED_SUMS]))

    cell = ["model_id", "venue", "category", "window_label", "horizon", "variant"]
    parts = cell_parts(base, list(PAIRED_SUMS), [n for n, _ in in_window], [n for n, _ in in_variant])
    n, mean = F.sum("n_clusters"), F.sum(F.col("n_clusters") * F.col("mean")) / F.sum("n_clusters")
    spread = F.sum(F.col("m2") + F.col("n_clusters") * F.col("mean") * F.col("mean")) - n * mean * mean
    cells = parts.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in PAIRED_SUMS], n.alias("n_clusters"), mean.alias("skill_cluster_mean"),
                                     F.when(n > 1, F.greatest(F.lit(0.0), spread) / (n - 1)).alias("__var"))
    total = F.col("s_n")
    out = cells.select(
        *cell, total.cast("long").alias("n"), "n_clusters", (F.col("s_model") / total).alias("brier_model"), (F.col("s_market") / total).alias("brier_market"),
        (F.col("s_skill") / total).alias("skill"), (F.col("s_ll_model") / total).alias("log_loss_model"), (F.col("s_ll_market") / total).alias("log_loss_market"),
        (2.8 * F.sqrt("__var") / F.sqrt("n_clusters")).alias("mde"), "skill_cluster_mean", F.coalesce("__var", F.lit(0.0)).alias("skill_cluster_var"))
    return sequence_columns(out, "skill_cluster_mean", "skill_cluster_var", "n_clusters", alpha).drop("skill_cluster_mean", "skill_cluster_var")


#: Signature rows that a task adds up at once; a cluster has no more than there are signatures.
CHUNK_ROWS = 100_000


def cell_parts(base: DataFrame, sums: list[str], in_window: list[str], in_variant: list[str]) -> DataFrame:
    """Sums, number of clusters, mean and squared deviations of their means, for each cell and chunk of whole clusters.

    A cluster enters some forty cells. They are never made into rows: a task reads its clusters in order and
    adds up one cell's rows after the other, by the bits of window and variant.
    """
    texts = ["model_id", "venue", "cluster_id", "category", "stated_bucket", "realized_bucket"]
    names = ["model_id", "venue", "category", "window_label", "horizon", "variant", *sums, "n_clusters", "mean", "m2"]

    def coded(column) -> tuple[np.ndarray, list]:
        column = column.combine_chunks().dictionary_encode(null_encoding="encode")
        return column.indices.to_numpy(zero_copy_only=False).astype("i8"), column.dictionary.to_pylist()

    def parts(t: pa.Table, cluster: np.ndarray, codes: dict) -> pa.RecordBatch:
        out = {n: [] for n in names}
        control, window, variant = (t[n].to_numpy() for n in ("is_control", "window_bits", "variant_bits"))
        values = np.column_stack([t[n].to_numpy().astype("f8") for n in sums])
        (model, models), (venue, venues) = codes["model_id"], codes["venue"]
        everyone, pooled = (np.zeros(len(cluster), "i8"), ["ALL"]), ("all", "ALL")
        for source, label, only in ((everyone, lambda x: pooled, None), (codes["category"], lambda x: ("all", x), None),
                                    (codes["stated_bucket"], lambda x: (f"hs_{x}", "ALL"), None),
                                    (codes["realized_bucket"], lambda x: (f"hr_{x}", "ALL"), "confirmatory")):
            code, known = source
            usable = np.array([x is not None for x in known], bool)[code] & (~control | (source is everyone))
            order = np.flatnonzero(usable)
            order = order[np.argsort(cluster[order] * len(known) + code[order], kind="stable")]
            for w, window_label in [*enumerate(in_window), (None, "null_control")]:
                if only not in (None, window_label):
                    continue
                of_window = order[control[order]] if w is None else order[~control[order] & (window[order] >> w & 1 == 1)]
                for v, variant_label in enumerate(in_variant):
                    at = of_window[variant[of_window] >> v & 1 == 1]
                    if not len(at):
                        continue
                    key = cluster[at] * len(known) + code[at]
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    s = np.add.reduceat(values[at], first, axis=0)
                    mean = s[:, sums.index("s_skill")] / s[:, sums.index("s_n")]
                    lead = at[first]
                    cells, inside = np.unique((model[lead] * len(venues) + venue[lead]) * len(known) + code[lead], return_inverse=True)
                    n = np.bincount(inside)
                    means = np.bincount(inside, mean) / n
                    for x in cells.tolist():
                        horizon, category = label(known[x % len(known)])
                        for name, value in (("model_id", models[x // len(known) // len(venues)]), ("venue", venues[x // len(known) % len(venues)]), ("category", category),
                                            ("window_label", window_label), ("horizon", horizon), ("variant", variant_label)):
                            out[name].append(value)
                    for j, name in enumerate(sums):
                        out[name] += np.bincount(inside, s[:, j]).tolist()
                    out["n_clusters"] += n.tolist()
                    out["mean"] += means.tolist()
                    out["m2"] += np.bincount(inside, (mean - means[inside]) ** 2).tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[n], pa.string() if k < 6 else pa.int64() if n == "n_clusters" else pa.float64()) for k, n in enumerate(names)], names)

    def step(batches):
        held, size = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.num_rows
            if not size or b is not None and size < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            codes = {n: coded(t[n]) for n in texts}
            own = [codes[n][0] for n in texts[:3]]
            new = np.append(True, np.any([x[1:] != x[:-1] for x in own], axis=0))
            # the last cluster may go on in the next batch
            end = t.num_rows if b is None else int(np.flatnonzero(new)[-1])
            if end:
                yield parts(t.slice(0, end), np.cumsum(new)[:end], {n: (c[:end], known) for n, (c, known) in codes.items()})
            held, size = t.slice(end).to_batches(), t.num_rows - end

    ordered = base.sortWithinPartitions("model_id", "venue", "cluster_id").select(*texts, "is_control", "window_bits", "variant_bits", *sums)
    kinds = ", ".join(f"{n} {'string' if k < 6 else 'long' if n == 'n_clusters' else 'double'}" for k, n in enumerate(names))
    return ordered.mapInArrow(step, kinds)
