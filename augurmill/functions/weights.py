"""Bounds on the weights of one small pool of models, in closed form over sorted weights.

Scaling weights up under a ceiling spends min(ceiling, t * w) each. With the k largest at the ceiling that sum is at
most k * ceiling + t * (the others), and equals the least of these lines over k, so the t that spends the total is the
greatest of theirs. Scaling down over a floor is the mirror image. A pool is one category's models, a dozen at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scale_up(df: DataFrame, keys: list[str], w: str, total: Column, ceiling: float) -> DataFrame:
    """Replaces `w` by min(ceiling, t * w) that sum to `total` within `keys`; all at the ceiling if that is too low."""
    from_here = Window.partitionBy(*keys).orderBy(F.desc(w), "model_id").rowsBetween(0, Window.unboundedFollowing)
    larger = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(w), "model_id")) - 1
    lines = df.withColumn("__t", (total - larger * ceiling) / F.sum(w).over(from_here))
    return lines.withColumn(w, F.least(F.lit(ceiling), F.max("__t").over(Window.partitionBy(*keys)) * F.col(w))).drop("__t")


def scale_down(df: DataFrame, keys: list[str], w: str, total: Column, floor: float) -> DataFrame:
    """Replaces `w` by max(floor, t * w) that sum to `total` within `keys`; all at the floor if that is too high."""
    from_here = Window.partitionBy(*keys).orderBy(w, "model_id").rowsBetween(0, Window.unboundedFollowing)
    smaller = F.row_number().over(Window.partitionBy(*keys).orderBy(w, "model_id")) - 1
    lines = df.withColumn("__t", (total - smaller * floor) / F.sum(w).over(from_here))
    return lines.withColumn(w, F.greatest(F.lit(floor), F.min("__t").over(Window.partitionBy(*keys)) * F.col(w))).drop("__t")


def shares(pool: DataFrame) -> DataFrame:
    """Adds `weight`: `raw` as a share of its category, equal shares where nothing is above zero."""
    own = Window.partitionBy("category")
    return pool.withColumn("weight", F.when(F.sum("raw").over(own) > 0, F.col("raw") / F.sum("raw").over(own)).otherwise(1 / F.count("*").over(own)))


def bound_weights(pool: DataFrame, floor: float = 0.02, ceiling: float = 0.60) -> DataFrame:
    """`pool` is (category, model_id, raw); adds `weight`: shares clipped to the bounds, then what the clipping left
    over or took too much is shared out in proportion within the bounds."""
    clipped = shares(pool).withColumn("weight", F.least(F.lit(ceiling), F.greatest(F.lit(floor), "weight")))
    clipped = clipped.withColumn("__sum", F.sum("weight").over(Window.partitionBy("category"))).withColumn("__up", F.col("weight")).withColumn("__down", F.col("weight"))
    both = scale_down(scale_up(clipped, ["category"], "__up", F.lit(1.0), ceiling), ["category"], "__down", F.lit(1.0), floor)
    return both.select("category", "model_id", "raw", F.when(F.col("__sum") < 1, F.col("__up")).otherwise(F.col("__down")).alias("weight"))


def correlated_groups(pool: DataFrame) -> DataFrame:
    """Adds `__group`, the least model of those that a chain of the category's `links` ("a|b" texts) reaches."""
    def join(groups: Column, link: Column) -> Column:
        met = F.filter(groups, lambda g: F.arrays_overlap(g, link))
        return F.concat(F.filter(groups, lambda g: ~F.arrays_overlap(g, link)), F.array(F.array_sort(F.flatten(met))))
    models = pool.groupBy("category").agg(F.collect_set("model_id").alias("models"), F.first("links", ignorenulls=True).alias("links"))
    pairs = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda t: F.split(t, r"\|"))
    groups = models.select("category", F.explode(F.aggregate(pairs, F.transform("models", lambda m: F.array(m)), join)).alias("g"))
    named = groups.select("category", F.explode("g").alias("model_id"), F.element_at("g", 1).alias("__group"))
    return pool.join(named, ["category", "model_id"])


def bound_weights_by_group(pool: DataFrame, floor: float = 0.02, ceiling: float = 0.60) -> DataFrame:
    """As above, where correlated models share one ceiling, which is at least a half, so that one group at most is above it.

    What such a group gives up goes to the others in proportion, then all are scaled down over the floor; a group that
    its members' floors lift above the ceiling is cut to it once more. One group of all models: equal weights.
    """
    category, group = Window.partitionBy("category"), Window.partitionBy("category", "__group")
    held, over = F.sum("weight").over(group), F.col("__held") > ceiling + 1e-12
    def rest(inside: Column) -> Column:
        """The weight of the group above the ceiling, or of a group it is not, times what fills the category."""
        top = F.max("__held").over(category)
        return F.when(over, inside).when(top > ceiling + 1e-12, F.col("weight") * (1 - ceiling) / (1 - top)).otherwise(F.col("weight"))
    w = shares(correlated_groups(pool)).withColumn("__n", F.count("*").over(category)).withColumn("__m", F.count("*").over(group)).withColumn("__held", held)
    w = w.withColumn("weight", rest(F.col("weight") * ceiling / F.col("__held")))
    w = scale_down(w, ["category"], "weight", F.lit(1.0), floor).withColumn("__held", held).withColumn("__cut", F.col("weight"))
    w = scale_down(w, ["category", "__group"], "__cut", F.lit(ceiling), floor).withColumn("weight", rest(F.col("__cut")))
    whole = F.max("__m").over(category) == F.col("__n")
    return w.withColumn("weight", F.when(whole, 1 / F.col("__n")).otherwise(F.col("weight"))).select("category", "model_id", "raw", "weight")
