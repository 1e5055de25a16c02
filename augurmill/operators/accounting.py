"""Wealth per model and the paper-trade book."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from augurmill.functions import exprs as X
from augurmill.functions.prefix import running
from augurmill.operators import models as M
from augurmill.operators.estimators import P, Q, Y
from augurmill.session import cut, scratch_path

# The sizing and entry rules.
KELLY, MARKET_CAP, CATEGORY_CAP, BANKROLL = 0.2, 0.05, 0.20, 10_000.0
MIN_EDGE, MAX_SPREAD, MIN_DEPTH, BOUNDS = 0.05, 0.03, 500.0, (0.05, 0.95)
SLIPPAGE, SLIPPAGE_CAP, MAX_ENTRY = 0.5, 0.02, 0.999


def kelly_fraction(p: Column, price: Column) -> Column:
    star = F.when((price > 0) & (price < 1), (p - price) / F.when(price != 1, 1 - price))
    return F.when(star > 0, F.least(star * KELLY, F.lit(MARKET_CAP))).otherwise(0.0)


def kelly_delta(rows: DataFrame) -> DataFrame:
    """Side, its price, the capped fraction and the log growth given the outcome."""
    yes = F.col(P) > F.col(Q)
    out = (rows.withColumn("side", F.when(yes, "YES").otherwise("NO"))
           .withColumn("price", F.when(yes, F.col(Q)).otherwise(1 - F.col(Q)))
           .withColumn("p_win", F.when(yes, F.col(P)).otherwise(1 - F.col(P)))
           .withColumn("kelly", kelly_fraction(F.col("p_win"), F.col("price"))))
    won = (F.col(Y) == 1) == (F.col("side") == "YES")
    f = F.col("kelly")
    delta = F.when(f <= 0, 0.0).when(won, F.log(1 - f + f / F.col("price"))).otherwise(F.log(1 - f))
    return out.withColumn("log_wealth_delta", delta).drop("p_win")


def wealth_ledger(scored: DataFrame, ledger: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """New ledger rows: running growth and count per (model, category) in (entry, ts, id) order.

    Forecasts already in the ledger are left out and its last state is carried
    on, so a second run adds nothing. Sums are prefix sums over range slices.
    `state` alone says the caller has already left out the written rows.
    """
    rows = scored.withColumn("category", F.coalesce("category", F.lit("unknown")))
    if ledger is not None:
        rows = rows.join(ledger.select("forecast_id"), "forecast_id", "left_anti")
        state = expert_state(ledger)
    grown = kelly_delta(rows).select("model_id", "category", "condition_id", "event_id", "forecast_id", "entry_s", "ts_s",
                                     "kelly", "log_wealth_delta")
    out = running(grown, ["model_id", "category"], ["entry_s", "ts_s", "forecast_id"],
                  sums={"cum_log_wealth": F.col("log_wealth_delta")}, count="n_forecasts")
    if state is None:
        return out
    last = state.select("model_id", "category", F.col("cum_log_wealth").alias("c0"), F.col("n_forecasts").alias("n0"))
    return (out.join(last, ["model_id", "category"], "left")
            .withColumn("cum_log_wealth", F.col("cum_log_wealth") + F.coalesce("c0", F.lit(0.0)))
            .withColumn("n_forecasts", F.col("n_forecasts") + F.coalesce("n0", F.lit(0))).drop("c0", "n0"))


def expert_state(ledger: DataFrame) -> DataFrame:
    return (ledger.groupBy("model_id", "category")
            .agg(F.max_by(F.struct("cum_log_wealth", "n_forecasts"), F.col("n_forecasts")).alias("s")).select("model_id", "category", "s.*"))


def expert_sums(scored: DataFrame) -> DataFrame:
    """The state that a ledger of all these rows ends in, added up without the ledger's order."""
    rows = kelly_delta(scored.withColumn("category", F.coalesce("category", F.lit("unknown"))))
    return rows.groupBy("model_id", "category").agg(F.sum("log_wealth_delta").alias("cum_log_wealth"), F.count(F.lit(1)).alias("n_forecasts"))


def expert_ranking(ledger: DataFrame) -> DataFrame:
    """Newest state, average growth per forecast, rank inside the category (a handful of models)."""
    return ranked(expert_state(ledger))


def ranked(state: DataFrame) -> DataFrame:
    avg = F.col("cum_log_wealth") / F.col("n_forecasts")
    rank = F.rank().over(Window.partitionBy("category").orderBy(F.col("avg_log_wealth").desc()))
    return state.withColumn("avg_log_wealth", avg).withColumn("rank", rank)


def drawdown(paths: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Value minus its running maximum along each path."""
    return (running(paths, by, order, maxes={"peak": F.col(value)})
            .withColumn("drawdown", F.col(value) - F.col("peak")))


#: Draws that one task puts in order at once, steps of a path whose replicates meet in one task, draws that one task hashes, and those of a piece.
SLICE_DRAWS, STEP_BLOCK, TASK_DRAWS, PIECE_DRAWS = 4_000_000, 10_000, 5_000_000, 1_000_000


def wealth_bands(deltas: DataFrame, by: list[str], replicates: int = 500, seed: int = 0) -> DataFrame:
    """5 % and 95 % of the cumulative path over random orders, per step.

    A replicate orders a cell's rows by the hash of seed, replicate and id. Hashes are even, so equal ranges of them hold
    about as many rows and need no sample: a task orders one cell's range in all replicates, and goes on from the counts
    and sums of the ranges before. Steps that all replicates take inside one range are done there; only those about
    the ends of ranges, whose sums lie in two of them, meet in blocks of steps. What is shuffled, once for the counts and
    the paths, is 10 bytes for each draw (hash and place of its value; two rows of a cell share the first 64 bits of a
    hash once in millions of runs, and then lie by value), and 8 for each sum about the ends.
    """
    rows = deltas.select(*by, "forecast_id", F.coalesce("log_wealth_delta", F.lit(0.0)).alias("log_wealth_delta"))
    at = scratch_path(deltas.sparkSession, "bands")
    rows.write.parquet(at)
    rows = deltas.sparkSession.read.schema(rows.schema).parquet(at)
    total, largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    slices = 1 + (largest or 0) * replicates // SLICE_DRAWS
    # every row is hashed for each replicate, so tasks are dealt by draws, not by bytes; a cell's rows lie together in them
    tasks = max(deltas.sparkSession.sparkContext.defaultParallelism, 1 + (total or 0) * replicates // TASK_DRAWS)
    rows = rows.repartitionByRange(tasks, *by, "forecast_id").sortWithinPartitions(*by)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    types = [to_arrow_type(rows.schema[c].dataType) for c in by]

    def pieces(batches):
        """The draws of some rows of a cell, by range of the hashes: how many in each replicate, and of each the hash and the row."""
        starts = [sha256(f"{seed}|{r}|".encode()) for r in range(1, replicates + 1)]
        step = max(1, min(65_535, PIECE_DRAWS // replicates))
        for b in batches:
            ids = [i.encode() for i in b.column("forecast_id").to_pylist()]
            values = b.column("log_wealth_delta").to_numpy(zero_copy_only=False).astype("f8")
            cells: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*[b.column(c).to_pylist() for c in by])):
                cells.setdefault(key, []).append(k)
            for key, every in cells.items():
                for own in (every[k:k + step] for k in range(0, len(every), step)):
                    h = np.empty((replicates, len(own)), "u8")
                    for r, start in enumerate(starts):
                        digests = []
                        for k in own:
                            whole = start.copy()  # the hash of its beginning goes on
                            whole.update(ids[k])
                            digests.append(whole.digest())
                        h[r] = np.frombuffer(b"".join(digests), ">u8")[::4]
                    where = ((h >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.min_scalar_type(slices)).ravel()
                    order, ends = np.argsort(where, kind="stable"), np.cumsum(np.bincount(where, minlength=slices))
                    h, v, out = h.ravel(), values[own].tobytes(), []
                    for k, (lo, hi) in enumerate(zip(np.append(0, ends), ends)):
                        if hi > lo:
                            rep, row = np.divmod(order[lo:hi], len(own))
                            n = np.bincount(rep, minlength=replicates)
                            out.append((k, n.astype("<u2").tobytes(), h[order[lo:hi]].astype("<u8").tobytes(), row.astype("<u2").tobytes(), v))
                    piece, *blobs = zip(*out)
                    keys = [pa.array([x] * len(piece), t) for x, t in zip(key, types)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(piece, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], [*by, "slice", "n", "h", "row", "v"])

    def drawn(own):
        """Replicate and value of a range's draws."""
        n = np.concatenate([np.frombuffer(x, "<u2") for x in own["n"]])
        rep = np.repeat(np.tile(np.arange(replicates, dtype="u2"), len(own)), n)
        return rep, np.concatenate([np.frombuffer(v, "<f8")[np.frombuffer(x, "<u2")] for x, v in zip(own["row"], own["v"])])

    def sums(key, own):
        rep, v = drawn(own)
        out = pd.DataFrame({"rep": np.arange(replicates), "n": np.bincount(rep, minlength=replicates), "s": np.bincount(rep, v, replicates)})
        for j, c in enumerate([*by, "slice"]):
            out[c] = key[j]
        return out[[*by, "slice", "rep", "n", "s"]]

    place = [*by, "slice"]
    draws = rows.mapInArrow(pieces, f"{kinds}, slice int, n binary, h binary, row binary, v binary").groupBy(*place)
    totals = draws.applyInPandas(sums, f"{kinds}, slice int, rep int, n long, s double")
    # as many rows in a window as there are ranges; every range of a cell gets its replicates' starts in one list
    before = Window.partitionBy(*by, "rep").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "slice", "rep", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"))

    def quantiles(table):
        """Some steps at a time, since they are copied."""
        return np.concatenate([np.quantile(table[:, k:k + 1000], [0.05, 0.95], axis=0) for k in range(0, table.shape[1], 1000)], axis=1)

    def paths(key, own, offset):
        """Bands of the steps that lie here in all replicates (rep -1), and the replicates' sums of the others."""
        rep, v = drawn(own)
        order, ends = np.argsort(rep, kind="stable"), np.append(0, np.cumsum(np.bincount(rep, minlength=replicates)))
        v = v[order]
        h = np.concatenate([np.frombuffer(x, "<u8") for x in own["h"]])[order]
        del rep, order
        offset = offset.sort_values("rep")
        first, sums_before = offset["n0"].to_numpy(), offset["s0"].to_numpy()
        for r, (lo, hi) in enumerate(zip(ends, ends[1:])):
            k = np.argsort(h[lo:hi], kind="stable")
            if (np.diff(h[lo:hi][k]) == 0).any():
                k = np.lexsort((v[lo:hi], h[lo:hi]))
            v[lo:hi] = sums_before[r] + np.cumsum(v[lo:hi][k])
        del h
        last = first + np.diff(ends)
        begin, end = first.max(), last.min()
        end = max(begin, end)
        out = []

        def add(r, start, values):
            """Sums from this step on, or the two rows of a band, split by block."""
            lo, n = 0, values.shape[-1]
            while lo < n:
                block, inside = divmod(int(start) + lo, STEP_BLOCK)
                hi = min(n, lo + STEP_BLOCK - inside)
                out.append((*key[:-1], block, r, inside, values[..., lo:hi].tobytes()))
                lo = hi

        if end > begin:
            add(-1, begin, quantiles(np.stack([v[lo + begin - f:lo + end - f] for lo, f in zip(ends, first)])))
        for r, (lo, f, l) in enumerate(zip(ends, first, last)):
            add(r, f, v[lo:lo + max(0, min(begin, l) - f)])
            add(r, max(end, f), v[lo + max(end, f) - f:lo + l - f])
        return pd.DataFrame(out, columns=[*by, "block", "rep", "inside", "cum"])

    def bands(key, own):
        done = [(i + np.arange(len(x) // 16), np.frombuffer(x, "f8").reshape(2, -1)) for r, i, x in zip(own["rep"], own["inside"], own["cum"]) if r < 0]
        spans = [(r, i, np.frombuffer(x, "f8")) for r, i, x in zip(own["rep"], own["inside"], own["cum"]) if r >= 0]
        if spans:
            met = np.zeros(STEP_BLOCK, bool)
            for _, i, x in spans:
                met[i:i + len(x)] = True
            at = np.cumsum(met) - 1
            table = np.empty((replicates, at[-1] + 1))
            for r, i, x in spans:  # the steps of a span have no gap among those met
                table[r, at[i]:at[i] + len(x)] = x
            done.append((np.flatnonzero(met), quantiles(table)))
        steps, (lo, hi) = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done], axis=1)
        out = pd.DataFrame({"step": key[-1] * STEP_BLOCK + 1 + steps, "lo": lo, "hi": hi})
        for j, c in enumerate(by):
            out[c] = key[j]
        return out[[*by, "step", "lo", "hi"]]

    sums_on_paths = draws.cogroup(offsets.groupBy(*place)).applyInPandas(paths, f"{kinds}, block long, rep int, inside int, cum binary")
    return sums_on_paths.groupBy(*by, "block").applyInPandas(bands, f"{kinds}, step long, lo double, hi double")


def attribution(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean weight x logit per model and category over the pools of the given forecasts."""
    return M.pool_members(forecasts, weights).groupBy("model_id", "category").agg(
        F.avg(F.col("share") * F.col("logit")).alias("mean_contribution"), F.count(F.lit(1)).alias("n_markets"))


def trade_screen(forecasts: DataFrame, books: DataFrame, open_trades: DataFrame) -> DataFrame:
    """Trades the entry rules allow, with fill price, stake and fee.

    `forecasts`: today's rows of liquid markets with `taker_rate`; `books`: newest quotes.
    """
    b = books.select("condition_id", "best_bid", "best_ask", "bid_depth_usd", "ask_depth_usd")
    yes = F.col(P) > F.col(Q)
    rows = (forecasts.join(open_trades.where("status = 'open'").select("condition_id"), "condition_id", "left_anti").join(b, "condition_id")
            .withColumn("side", F.when(yes, "YES").otherwise("NO"))
            .withColumn("depth", F.when(yes, F.col("ask_depth_usd")).otherwise(F.col("bid_depth_usd")))
            .withColumn("raw_price", F.when(yes, F.coalesce("best_ask", Q)).otherwise(1 - F.coalesce("best_bid", Q)))
            .withColumn("edge", F.abs(F.col(P) - F.col(Q))))
    ok = ((F.col(Q) > BOUNDS[0]) & (F.col(Q) < BOUNDS[1]) & (F.col("edge") >= MIN_EDGE)
          & (F.col("spread_at_ts") <= MAX_SPREAD) & (F.col("depth") >= MIN_DEPTH))
    p_win = F.when(F.col("side") == "YES", F.col(P)).otherwise(1 - F.col(P))
    stake = BANKROLL * kelly_fraction(p_win, F.col("raw_price"))
    slip = F.when(F.col("depth") <= 0, SLIPPAGE_CAP).otherwise(F.least(F.lit(SLIPPAGE_CAP), SLIPPAGE * F.col("stake") / F.col("depth")))
    return (rows.where(ok).withColumn("stake", stake).where("stake > 0")
            .withColumn("entry_price", F.least(F.lit(MAX_ENTRY), F.col("raw_price") + slip))
            .withColumn("fee", F.col("taker_rate") * (1 - F.col("entry_price")) * F.col("stake")))


def exposure_admit(candidates: DataFrame, open_exposure: DataFrame, cap: float = CATEGORY_CAP * BANKROLL,
                   fold_rows: int = 20_000, max_rounds: int = 1000) -> DataFrame:
    """In `seq` order, admit a stake only while the category stays within the cap; skipped ones do not count.

    Each round folds the next `fold_rows` candidates of every category in
    order. What was used only grows, so a stake that no longer fits is out for
    good and is filtered before the next round takes its share. The head per
    category is a top-k, bounded before the shuffle; no category is ever
    gathered whole, and the result is that of one long fold.
    """
    pool = cut(candidates.select("category", "seq", "trade_id", "stake"))
    start = (pool.select("category").distinct().join(open_exposure.select("category", F.col("exposure").alias("used")), "category", "left")
             .select("category", F.coalesce("used", F.lit(0.0)).alias("used"), F.lit(None).cast(pool.schema["seq"].dataType).alias("last_seq"),
                     F.lit(None).cast("string").alias("last_id")))
    state, rounds = start, []
    after = (F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))
             | ((F.col("seq") == F.col("last_seq")) & (F.col("trade_id") > F.col("last_id"))))
    order = Window.partitionBy("category").orderBy("seq", "trade_id")
    for _ in range(max_rounds):
        # one row a category goes to the tasks; a join by category would bring each category into one task
        heads = (pool.join(F.broadcast(state), "category").where(after & (F.col("used") + F.col("stake") <= cap))
                 .withColumn("r", F.row_number().over(order)).where(F.col("r") <= fold_rows))
        items = heads.groupBy("category").agg(F.max("used").alias("used"),
                                              F.array_sort(F.collect_list(F.struct("seq", "trade_id", "stake"))).alias("items"))
        zero = F.struct(F.col("used").alias("used"), F.expr("cast(array() as array<string>)").alias("ids"))
        fold = F.aggregate("items", zero, lambda acc, x: F.when(
            acc["used"] + x["stake"] <= cap,
            F.struct((acc["used"] + x["stake"]).alias("used"), F.concat(acc["ids"], F.array(x["trade_id"])).alias("ids"))).otherwise(acc))
        last = F.element_at("items", -1)
        done = cut(items.select("category", fold.alias("f"), last["seq"].alias("last_seq"), last["trade_id"].alias("last_id"),
                                F.size("items").alias("n")))
        rounds.append(done.select("category", F.explode("f.ids").alias("trade_id")))
        state = done.where(F.col("n") == fold_rows).select("category", F.col("f.used").alias("used"), "last_seq", "last_id")
        if state.isEmpty():
            break
    else:
        raise RuntimeError("exposure_admit did not settle; raise max_rounds")
    ids = rounds[0]
    for more in rounds[1:]:
        ids = ids.unionByName(more)
    return pool.join(ids, ["category", "trade_id"], "left_semi").select("category", "seq", "trade_id", "stake")


def trade_settle(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    """P&L of open trades with an outcome, net of the entry fee."""
    won = (F.col(Y) == 1) == (F.col("token_side") == "YES")
    pnl = F.col("stake") / F.col("entry_price") * won.cast("int") - F.col("stake") - F.coalesce("fee", F.lit(0.0))
    return (trades.where("status = 'open'").join(resolutions.select("condition_id", Y, "resolved_s"), "condition_id")
            .withColumn("pnl", pnl).withColumn("exit_s", F.col("resolved_s")).drop(Y, "resolved_s").withColumn("status", F.lit("resolved")))


def deepest_drawdown(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """`max_drawdown`, the least distance of the running sum of all rows from its maximum so far; it starts at zero, so
    a first loss is already a drawdown.

    Rows are dealt by ranges of the order. A task reads its range once and keeps its sum, highest and lowest point and
    deepest drawdown; these four numbers are enough to put the ranges together.
    """
    first = rows.select(*order).schema

    def step(batches):
        at, total, top, low, dip = None, 0.0, -np.inf, np.inf, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            at = at or [b.column(c)[0].as_py() for c in order]
            path = total + np.cumsum(b.column(value).to_numpy(zero_copy_only=False))
            tops = np.maximum(np.maximum.accumulate(path), top)
            total, top, low, dip = path[-1], tops[-1], min(low, path.min()), min(dip, (path - tops).min())
        if at:
            yield pa.RecordBatch.from_arrays([*[pa.array([x], to_arrow_type(f.dataType)) for x, f in zip(at, first)], *[pa.array([float(x)]) for x in (total, top, low, dip)]], [*order, "total", "top", "low", "dip"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first)
    ranged = rows.select(*order, F.coalesce(value, F.lit(0.0)).alias(value)).repartitionByRange(*order).sortWithinPartitions(*order)
    # a row for each range from here on
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.mapInArrow(step, f"{kinds}, total double, top double, low double, dip double").withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("start") + F.col("top")).over(before), F.lit(0.0)))
    dips = parts.select(F.least("dip", F.col("start") + F.col("low") - peak).alias("dip"))
    return dips.agg(F.coalesce(F.least(F.lit(0.0), F.min("dip")), F.lit(0.0)).alias("max_drawdown"))


def trade_summary(resolved: DataFrame, still_open: DataFrame, latest: DataFrame) -> DataFrame:
    """One row: realized, fees, gross, hit rate, mark-to-market and the deepest drawdown."""
    done = resolved.agg(
        F.count(F.lit(1)).alias("resolved_trades"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realized_pnl"),
        F.coalesce(F.sum("fee"), F.lit(0.0)).alias("total_fees"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"))
    mark = F.when(F.col("token_side") == "YES", F.col("mid")).otherwise(1 - F.col("mid"))
    held = still_open.join(latest.select("condition_id", "mid"), "condition_id", "left").agg(
        F.count(F.lit(1)).alias("open_trades"),
        F.coalesce(F.sum(F.col("stake") / F.col("entry_price") * mark - F.col("stake")), F.lit(0.0)).alias("unrealized_pnl"))
    low = deepest_drawdown(resolved.select("exit_s", "trade_id", "pnl"), ["exit_s", "trade_id"], "pnl")
    # three one-row aggregates
    return (done.crossJoin(held).crossJoin(low)
            .withColumn("gross_pnl", F.col("realized_pnl") + F.col("total_fees"))
            .withColumn("hit_rate", F.when(F.col("resolved_trades") > 0, F.col("wins") / F.col("resolved_trades"))).drop("wins"))
