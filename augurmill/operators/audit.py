"""Digests of ledger days and exports, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurmill.functions import exprs as X

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # sha256 of no rows


def _joined(items: str, field: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.col(items)), lambda x: x[field]), "\n"), 256)


def tree_digest(rows: DataFrame, by: list[str], id_col: str, text: Column) -> DataFrame:
    """Order-free digest per key as a three-level hash tree.

    Rows go to leaves by the first six hex digits of sha256(id), leaves to
    nodes by the first three, nodes to the root. No list ever holds more than
    4096 children, and a leaf holds one 2^24th of its day, so a day with a
    third of the ledger never meets in one task. Only digests are shuffled.
    """
    hashed = rows.select(
        *by, F.col(id_col).alias("__id"), F.sha2(F.col(id_col).cast("string"), 256).alias("h"),
        F.sha2(text, 256).alias("d"))
    leaves = (hashed.groupBy(*by, F.substring("h", 1, 3).alias("node"), F.substring("h", 1, 6).alias("leaf"))
              .agg(F.collect_list(F.struct("h", "d")).alias("items"), F.count(F.lit(1)).alias("n"),
                   F.min("__id").alias("first_id"), F.max("__id").alias("last_id"))
              .select(*by, "node", "leaf", "n", "first_id", "last_id", _joined("items", "d").alias("d")))

    def up(level: DataFrame, keys: list[str], child: str) -> DataFrame:
        return (level.groupBy(*keys)
                .agg(F.collect_list(F.struct(child, "d")).alias("items"), F.sum("n").alias("n"),
                     F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
                .select(*keys, "n", "first_id", "last_id", _joined("items", "d").alias("d")))

    root = up(up(leaves, by + ["node"], "leaf"), by, "node")
    return root.select(*by, F.col("n").alias("row_count"), "first_id", "last_id", F.col("d").alias("sha256"))


def day_digests(ledger: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    keyed = ledger.withColumn("day", X.day_of("ts_s"))
    return tree_digest(keyed, ["day"], id_col, X.canonical_row(cols))


def daily_digest(ledger: DataFrame, recorded: DataFrame, id_col: str, cols: list[str],
                 first_day: int, today: int, recorded_s: int) -> DataFrame:
    """One record for every closed day that has none; an empty day digests no rows.

    Only the missing days are read: they are one semi-join on the day.
    """
    days = (ledger.sparkSession.range(first_day, today).select(F.col("id").alias("day"))
            .join(recorded.select("day"), "day", "left_anti"))
    open_days = ledger.withColumn("day", X.day_of("ts_s")).join(days, "day", "left_semi")
    found = tree_digest(open_days, ["day"], id_col, X.canonical_row(cols))
    return days.join(found, "day", "left").select(
        "day", F.coalesce("row_count", F.lit(0)).alias("row_count"), "first_id", "last_id",
        F.coalesce("sha256", F.lit(EMPTY)).alias("sha256"),
        F.lit(recorded_s).cast("long").alias("recorded_s"),
        ((F.lit(today) - F.col("day")) <= 1).cast("int").alias("prospective"))


ID_BIN = 4096


def verify_records(ledger: DataFrame, records: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Recompute each record over its own id range.

    Records and rows meet on id bins, an equi-join; a record visits the bins
    its range covers. A zero-row record holds while its day is still empty.
    """
    ranges = records.where("row_count > 0 and first_id is not null and last_id is not null")
    binned = ranges.select("record_id", "first_id", "last_id", F.explode(F.sequence(
        F.floor(F.col("first_id") / ID_BIN), F.floor(F.col("last_id") / ID_BIN))).alias("id_bin"))
    held = (ledger.withColumn("id_bin", F.floor(F.col(id_col) / ID_BIN)).join(binned, "id_bin")
            .where(F.col(id_col).between(F.col("first_id"), F.col("last_id"))).drop("first_id", "last_id"))
    found = tree_digest(held, ["record_id"], id_col, X.canonical_row(cols)).select(
        "record_id", F.col("row_count").alias("found_n"), F.col("sha256").alias("found_sha"))
    days = ledger.select(X.day_of("ts_s").alias("day")).distinct().withColumn("day_has_rows", F.lit(True))
    checked = records.join(found, "record_id", "left").join(days, "day", "left")
    empty_ok = ((F.col("row_count") == 0) & F.col("first_id").isNull() & F.col("last_id").isNull()
                & F.col("day_has_rows").isNull() & (F.col("sha256") == EMPTY))
    full_ok = (F.col("row_count") > 0) & (F.col("found_n") == F.col("row_count")) & (F.col("found_sha") == F.col("sha256"))
    ok = F.coalesce(empty_ok, F.lit(False)) | F.coalesce(full_ok, F.lit(False))
    return checked.withColumn("ok", ok).select("record_id", "day", "row_count", "ok")


def verified_days(checked: DataFrame) -> DataFrame:
    """A day holds if any of its records does; the others of such a day are superseded."""
    n_ok = F.count(F.when(F.col("ok"), 1))
    return checked.groupBy("day").agg(
        F.count(F.lit(1)).alias("records"), (n_ok > 0).cast("int").alias("verified"),
        F.when(n_ok > 0, F.count(F.lit(1)) - n_ok).otherwise(0).alias("superseded"))


def export_digest(rows: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Row count, field set and digest of an export."""
    one = rows.withColumn("__all", F.lit(1))
    found = tree_digest(one, ["__all"], id_col, X.canonical_row(fields))
    return found.select("row_count", F.lit(",".join(sorted(fields))).alias("fields"), "sha256")


def export_verify(rows: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """Compare an export with its manifest row, each check on its own."""
    found = export_digest(rows, id_col, [c for c in rows.columns])
    m = manifest.select(*[F.col(c).alias(f"m_{c}") for c in ("row_count", "fields", "sha256")])
    # one row on either side
    return m.crossJoin(found).select(
        (F.col("row_count") == F.col("m_row_count")).cast("int").alias("count_ok"),
        (F.col("fields") == F.col("m_fields")).cast("int").alias("fields_ok"),
        (F.col("sha256") == F.col("m_sha256")).cast("int").alias("digest_ok"))


def increment_verify(ledger_digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Mirrored day counts and digests against the ledger's, per (table, day)."""
    a = ledger_digests.select("table", "day", F.col("row_count").alias("n"), F.col("sha256").alias("d"))
    b = manifest.select("table", "day", F.col("row_count").alias("mn"), F.col("sha256").alias("md"))
    state = (F.when(F.col("md").isNull(), "not_mirrored").when(F.col("d").isNull(), "not_in_ledger")
             .when(F.col("n") != F.col("mn"), "row_count_mismatch").when(F.col("d") != F.col("md"), "digest_mismatch")
             .otherwise("ok"))
    return a.join(b, ["table", "day"], "full_outer").select("table", "day", "n", "mn", state.alias("state"))


def manifest_backfill(ledger_digests: DataFrame, mirrored_days: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows for days that were mirrored before there was a manifest."""
    missing = mirrored_days.select("table", "day").distinct().join(manifest.select("table", "day"), ["table", "day"], "left_anti")
    return ledger_digests.join(missing, ["table", "day"], "left_semi")


def ledger_audit(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Rows of the old ledger that the new one lost or changed."""
    cols = [c for c in old.columns if c in new.columns and c != id_col]
    stamp = F.xxhash64(*[F.col(c) for c in sorted(cols)])
    a = old.select(id_col, stamp.alias("h_old"))
    b = new.select(id_col, stamp.alias("h_new"))
    change = F.when(F.col("h_new").isNull(), "removed").when(F.col("h_new") != F.col("h_old"), "changed")
    return (a.join(b, id_col, "left").withColumn("change", change).where("change is not null")
            .select(id_col, "change"))
