"""The corpus pipeline: toxicity, near-duplicates, contamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads. All but
the last return the columns of documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm import decontam, neardup, packing, private, tokens, toxicity
from augurmill.llm.common import BATCH_ROWS, scratch_path, stored, table
from augurmill.session import prepare

#: No SQL expresses a trained field, signatures or a vocabulary; the tests compare with brute force.
ORACLE_SQL = None


def ready(spark: SparkSession) -> None:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def apart(docs: DataFrame, *more: Column) -> DataFrame:
    """text, and all other columns in one, so that none clashes with what a stage adds."""
    return docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"), "text", *more)


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in columns])


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained field does not call toxic. Labels are those one may learn from."""
    ready(spark)
    field = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    out = toxicity.toxicity(apart(docs), field, keep=["__row", "text"], spans=False)
    return together(out.where("predicted = 0"), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id."""
    ready(spark)
    classes = stored(neardup.near_duplicates(docs).select("__key", "first"), "classes")
    keyed = apart(docs, neardup.row_key().alias("__key"))
    kept = keyed.join(classes.where("first").select("__key"), "__key", "left_semi")
    # rows that repeat doc_id and text share the key of the one that stays
    if not classes.groupBy("__key").agg(F.count("*").alias("c"), F.max("first").alias("kept")).where("c > 1 and kept").isEmpty():
        kept = kept.dropDuplicates(["__key"])
    return together(kept, docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    ready(spark)
    kept = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "text")
    out = decontam.contamination(own, table(spark, sf_dir, "benchmark"), keep=["__row"])
    return out.where(~F.col("contaminated")).select(*[F.col("__row")[c].alias(c) for c in kept])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; n_chars follows the text."""
    ready(spark)
    kept = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "text")
    found = private.personal_data(own, keep=["__row"])
    spans = F.array_sort(F.concat("base_spans", "found_spans"), lambda a, b: (a["start"] - b["start"]).cast("int"))
    cut = found.select("__row", F.col("__row.text").alias("text"), spans.alias("spans"))
    return private.redacted(cut, kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in windows of 1024 ids."""
    ready(spark)
    return packing.pack(docs, tokens.tokenizer_path(), tokens.ranks_path())


STAGES = [("toxicity", keep_harmless), ("near_duplicates", keep_one_of_each), ("decontamination", keep_uncontaminated), ("personal_data", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
