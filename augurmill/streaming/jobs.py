"""Quotes, newest quotes, coverage and resolutions as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from augurmill.operators import accounting, scoring
from augurmill.schemas import COVERAGE, EXPERTS, RESOLUTIONS, WEALTH
from augurmill.sources import archive
from augurmill.sources import ledger as L

#: Folders of a keyed table. A batch reads and rewrites those of its own keys.
BUCKETS = 64


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    def once(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # a batch is read more than once, its state only moves on once
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()

    return (stream.writeStream.outputMode(mode).foreachBatch(once).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


@contextmanager
def placed_by_some_keys(spark: SparkSession) -> Iterator[None]:
    """Joins take rows where they are if those of equal keys lie together, even if placed by some of the keys only."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended."""
    fs, at = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


class Keyed:
    """A table of one row per key in plain Parquet, with a folder for each hash bucket of the key.

    A batch replaces the buckets of its own keys and touches no other file. What a
    bucket is to hold is written beside the table first; a batch retried after a
    failure, even amid the replacement, finds it there and only replaces again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of these rows' keys: no more than the table has."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        if not archive.has_files(self.spark, self.path, "bucket=*"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def upsert(self, batch_id: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`merge(new, old)` gives the rows of the touched buckets; `old` is what they hold now."""
        ready = f"{self.path}-next/batch={batch_id}"
        if not is_complete(self.spark, ready):
            merged = merge(new, self.read(self.touched(new))).withColumn("bucket", self.bucket())
            merged.repartition("bucket").write.mode("overwrite").parquet(ready)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(ready)
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))
        fs, at = _fs(self.spark, f"{self.path}-next/batch={batch_id - 1}")
        fs.delete(at, True)  # the batch before is settled


def stream_snapshots(quotes: DataFrame, minutes: int, path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Floor to the cadence, keep the first quote per (bucket, market), append by date and hour.

    A quote that arrives again within `delay` is dropped by keyed state, which
    then expires; the clock is that of arrival, so no quote is too late. Different
    quotes of a key pass: state keeps what a task happens to read first, so only
    the append chooses, by quote id. It drops keys the archive already holds, so
    however late a repeat comes, and however often a batch is retried, the first
    write stands.
    """
    floored = archive.ts_bucket(quotes, minutes).withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", delay)
    once = floored.dropDuplicatesWithinWatermark([*archive.KEY, "quote_id"]).drop("__arrived")
    return _run(once, checkpoint, lambda batch, _: archive.snapshot_append(batch, path))


LATEST = "condition_id string, ts_s bigint, quote_id string, mid double"


def latest(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Keyed:
    return Keyed(spark, path, LATEST, ["condition_id"], buckets)


def newest(quotes: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("ts_s", "quote_id", "mid"), F.struct("ts_s", "quote_id")).alias("q")
    return quotes.groupBy("condition_id").agg(best).select("condition_id", "q.*")


def stream_latest(quotes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Newest quote per market, by (ts_s, quote_id as a string): each batch's newest are merged into their markets' buckets."""
    table = latest(quotes.sparkSession, path, buckets)
    own = quotes.select("condition_id", "ts_s", F.col("quote_id").cast("string").alias("quote_id"), "mid")
    return _run(own, checkpoint, lambda batch, batch_id: table.upsert(batch_id, newest(batch), lambda new, old: newest(new.unionByName(old))))


def stream_coverage(quotes: DataFrame, markets: DataFrame, minutes: int, delay_s: int, path: str, checkpoint: str) -> StreamingQuery:
    """Quotes per tier and tumbling bucket, of every batch: late ones and those of buckets still open are counted too.

    A quote is late if its bucket had closed by the batches before: its end lay
    `delay_s` before their newest quote. A batch is one folder of a few rows, replaced
    whole if it is retried; `coverage` adds them up. Markets without a tier count as "unknown".
    """
    spark, span = quotes.sparkSession, minutes * 60
    tiers = markets.select("condition_id", "tier")
    own = quotes.join(tiers, "condition_id", "left").select(F.coalesce("tier", F.lit("unknown")).alias("tier"), "ts_s", (F.col("ts_s") - F.pmod("ts_s", F.lit(span))).alias("bucket_s"))

    def count(batch: DataFrame, batch_id: int) -> None:
        before = coverage_rows(spark, path).where(F.col("batch") < batch_id).agg(F.max("newest_s")).first()[0]
        late = F.lit(False) if before is None else F.col("bucket_s") + span <= before - delay_s
        counts = batch.groupBy("tier", "bucket_s").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.max("ts_s").alias("newest_s"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _run(own, checkpoint, count)


def coverage_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{COVERAGE}, batch bigint"
    return spark.read.schema(schema).parquet(path) if archive.has_files(spark, path, "batch=*") else spark.createDataFrame([], schema)


def coverage(spark: SparkSession, path: str, minutes: int, delay_s: int) -> DataFrame:
    """Counts of all batches; a closed bucket ended `delay_s` before the newest quote, and one that is missing is a gap."""
    rows = coverage_rows(spark, path)
    newest_s = rows.agg((F.max("newest_s") - delay_s - minutes * 60).alias("closed_to_s"))
    sums = rows.groupBy("tier", "bucket_s").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
    return sums.crossJoin(newest_s).withColumn("closed", F.col("bucket_s") <= F.col("closed_to_s")).drop("closed_to_s")  # one row


def wealth_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every batch's wealth rows. A batch is one folder, replaced whole if it is retried, split by the markets' buckets."""
    return spark.read.schema(f"{WEALTH}, batch bigint, bucket int").parquet(path)


def stream_resolutions(resolutions: DataFrame, forecasts: DataFrame, as_of: int, table_path: str, wealth_path: str,
                       state_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Outcomes in, wealth rows out: upsert, score, extend the wealth ledger by what is new.

    The ledger only grows by batch folders. Rows already in it can only belong to
    markets of this batch, so only the buckets of these are looked up. The running
    state per (model, category) takes its values from a batch's complete folder:
    a retry finds the folder, and does not add the batch to itself.

    Forecasts are read by every batch; where they are cached in their markets' places, outcomes and the ledger's rows come to them.
    """
    spark = resolutions.sparkSession
    known = Keyed(spark, table_path, RESOLUTIONS, ["condition_id"], buckets)
    state = Keyed(spark, state_path, EXPERTS, ["model_id", "category"], buckets)

    def settle(batch: DataFrame, batch_id: int) -> None:
        own = batch.select(*[F.col(f.name) for f in known.read([]).schema])
        known.upsert(batch_id, own, L.resolution_upsert)
        at = f"{wealth_path}/batch={batch_id}"
        if not is_complete(spark, at):
            markets, touched = own.select("condition_id").distinct(), known.touched(own)
            rows = scoring.scored_rows(forecasts, known.read(touched).join(markets, "condition_id", "left_semi"), None, as_of)
            if archive.has_files(spark, wealth_path, "batch=*"):
                written = wealth_rows(spark, wealth_path).where((F.col("batch") < batch_id) & F.col("bucket").isin(touched))
                written = written.select("condition_id", "forecast_id").join(markets, "condition_id", "left_semi")
                rows = rows.join(written, ["condition_id", "forecast_id"], "left_anti")
            with placed_by_some_keys(forecasts.sparkSession):
                added = accounting.wealth_ledger(rows, state=state.read())
                added.withColumn("bucket", known.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(at)
        added = spark.read.schema(f"{WEALTH}, bucket int").parquet(at)
        state.upsert(batch_id, accounting.expert_state(added), lambda new, old: accounting.expert_state(new.unionByName(old)))

    return _run(resolutions, checkpoint, settle)
