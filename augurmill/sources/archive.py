"""The quote archive: cadence floor, first-write-wins, partitioned append, pruned reads."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.schemas import SNAPSHOTS

KEY = ["condition_id", "ts_s"]


def ts_bucket_column(ts_s, minutes: int) -> Column:
    """Floor to the cadence: minutes inside the hour, whole hours of the day above 60."""
    ts = X.col(ts_s)
    if minutes > 60:
        span = (minutes // 60) * X.HOUR
        return ts - ts % X.DAY + F.floor((ts % X.DAY) / span).cast("long") * span
    return ts - ts % X.HOUR + F.floor((ts % X.HOUR) / (minutes * 60)).cast("long") * (minutes * 60)


def ts_bucket(df: DataFrame, minutes: int) -> DataFrame:
    return df.withColumn("ts_s", ts_bucket_column("ts_s", minutes))


def snapshot_dedup(batch: DataFrame, order: str = "quote_id") -> DataFrame:
    """One row per (bucket, market), the first written. A mergeable minimum, so
    repeated quotes of a hot market are dropped before the shuffle."""
    rest = [c for c in batch.columns if c not in KEY]
    first = batch.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.col(order)).alias("first"))
    return first.select(*KEY, "first.*").select(*batch.columns)


def with_partitions(df: DataFrame) -> DataFrame:
    stamp = F.timestamp_seconds("ts_s")
    return df.withColumn("date", F.to_date(stamp)).withColumn("hour", F.hour(stamp))


def new_rows(batch: DataFrame, archive: DataFrame | None, order: str = "quote_id") -> DataFrame:
    """The batch's first rows whose key the archive does not hold yet.

    One aggregate finds the batch's first and last date; the archive is read between them only.
    """
    fresh = with_partitions(snapshot_dedup(batch, order))
    if "quote_id" in fresh.columns:
        fresh = fresh.withColumn("quote_id", F.col("quote_id").cast("string"))
    if archive is None:
        return fresh
    first, last = batch.agg(F.to_date(F.timestamp_seconds(F.min("ts_s"))), F.to_date(F.timestamp_seconds(F.max("ts_s")))).first()
    if first is None:
        return fresh
    keys = archive.where(F.col("date").between(first, last)).select(*KEY, "date")
    return fresh.join(keys, KEY + ["date"], "left_anti")


def snapshot_append(batch: DataFrame, path: str, order: str = "quote_id") -> None:
    """Append first writes to the archive, split by date and hour. Running twice adds nothing."""
    spark = batch.sparkSession
    archive = snapshot_read(spark, path, columns=[*KEY, "date"]) if has_files(spark, path, "date=*") else None
    fresh = new_rows(batch, archive, order)
    # ranges keep an hour in one file or few, split a hot hour over tasks, and hold inside a stream's batch too, where
    # a rebalance hint is dropped: each task then wrote a file for each hour
    fresh.repartitionByRange("date", "hour", *KEY).write.mode("append").partitionBy("date", "hour").parquet(path)


def has_files(spark: SparkSession, path: str, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(root) and len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}"))) > 0


def snapshot_read(spark: SparkSession, path: str, dates: list[str] | None = None, columns: list[str] | None = None,
                  ids: DataFrame | None = None, schema: str = SNAPSHOTS) -> DataFrame:
    """Pruned archive scan: dates prune partitions, columns prune the files, an id
    table filters by semi-join. The declared schema reads columns missing from
    older files as null without opening their footers; an unreadable file fails the read."""
    df = spark.read.schema(schema).parquet(path)
    if dates is not None:
        df = df.where(F.col("date").isin([datetime.date.fromisoformat(d) for d in dates]))
    if columns is not None:
        df = df.select(*dict.fromkeys(columns + (["condition_id"] if ids is not None else [])))
    if ids is not None:
        df = df.join(ids.select("condition_id").distinct(), "condition_id", "left_semi")
    return df if columns is None else df.select(*columns)
