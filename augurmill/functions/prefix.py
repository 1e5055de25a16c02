"""Cumulative sums and maxima that never put one key into one task.

A plain window sorts a whole key in one task, and one key may hold a third of
all rows. Here rows are range-partitioned on (key, order), so a hot key spreads
over many partitions; each partition is summed on its own and shifted by the
totals of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurmill.session import scratch_path

SLICE, KEY = "__slice", "__key"


def slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Tag rows with their range slice. `order` must end in a unique column.

    A written table fixes the tags: range bounds are sampled, and a recomputed
    sample could move rows between the totals and the detail. Its columns are
    compressed, which a checkpoint's rows are not.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in keys + order])
    tagged, at = ranged.withColumn(SLICE, F.spark_partition_id()), scratch_path(df.sparkSession, "slices")
    tagged.write.parquet(at)
    return df.sparkSession.read.schema(tagged.schema).parquet(at)


def running(df: DataFrame, keys: list[str], order: list[str],
            sums: dict[str, Column] | None = None,
            maxes: dict[str, Column] | None = None,
            count: str | None = None) -> DataFrame:
    """Add running sums, maxima and a running count, each over (keys) by (order)."""
    sums, maxes = dict(sums or {}), dict(maxes or {})
    if count:
        sums[count] = F.lit(1).cast("long")
    # the keys as one struct: never null itself, equal where its fields are equal
    # or both null, so window and join below can share one placement
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    staged = df.withColumn(KEY, key)
    for name, value in {**sums, **maxes}.items():
        staged = staged.withColumn(f"__v_{name}", value)
    tagged = slices(staged, keys, order)

    totals = tagged.groupBy(KEY, SLICE).agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums],
        *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in maxes])
    # one row per (key, slice): a key spans at most as many rows as there are slices
    before = Window.partitionBy(KEY).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # only a slice's first key can have begun in a slice before: fewer rows than there are slices
    offsets = totals.withColumn("__begun", F.lag(SLICE).over(Window.partitionBy(KEY).orderBy(SLICE))).select(
        KEY, SLICE, "__begun", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums],
        *[F.max(f"__t_{n}").over(before).alias(f"__o_{n}") for n in maxes]).where("__begun is not null").drop("__begun")

    so_far = (Window.partitionBy(KEY, SLICE).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = tagged
    for n in sums:
        local = local.withColumn(n, F.sum(f"__v_{n}").over(so_far))
    for n in maxes:
        local = local.withColumn(n, F.max(f"__v_{n}").over(so_far))
    out = local.join(F.broadcast(offsets), [KEY, SLICE], "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0)))
    for n in maxes:
        out = out.withColumn(n, F.greatest(F.col(n), F.col(f"__o_{n}")))
    added = list(sums) + list(maxes)
    return out.select(*[c for c in df.columns if c not in added], *added)
