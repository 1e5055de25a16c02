"""The pipeline against what its operators say, stage by stage."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from augurmill.llm import decontam, neardup, private
from augurmill.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.dtypes
    counts = [docs.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.dtypes == columns
            counts.append(docs.count())
            if k != 3:
                assert docs.exceptAll(before).count() == 0
    assert counts[4] == counts[3] <= counts[2] <= counts[1] <= counts[0]
    redacted = spark.read.parquet(str(tmp_path / "3"))
    assert private.personal_data(redacted).where(F.size("base_spans") > 0).count() == 0
    left = spark.read.parquet(str(tmp_path / "2"))
    assert decontam.contamination(left, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert neardup.near_duplicates(left).where(~F.col("first")).count() == 0
    assert docs.select("doc_id").distinct().count() == counts[4]


@pytest.mark.parametrize("n", range(5))
def test_stages_on_nulls_empties_and_extra_columns(spark, tmp_path, n):
    rows = [(1, None, "a"), (None, "", "a"), (2, "see me@x.yz", "b"), (2, "see me@x.yz", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.length("text").cast("long"))
    for name, own in (("some", docs), ("none", docs.limit(0))):
        own.coalesce(1).write.parquet(str(tmp_path / name))
        out = cp.STAGES[n][1](spark, spark.read.parquet(str(tmp_path / name)), SF)
        assert n == 4 or out.columns == docs.columns
        assert out.count() == (0 if name == "none" else 3 if n == 1 else 4)
    if n == 3:
        assert cp.STAGES[3][1](spark, spark.read.parquet(str(tmp_path / "some")), SF).where("text = 'see [EMAIL]'").count() == 2


def test_one_of_each_does_not_depend_on_how_the_table_is_cut(spark, tmp_path):
    """Both readings of a table may be cut into other tasks, as when executors come or go between them."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(7)
    docs.write.parquet(str(tmp_path / "docs"))
    results = []
    for most in ("64k", "4m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            read = spark.read.parquet(str(tmp_path / "docs"))
            near = neardup.near_duplicates(read)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")  # for what is read from here on
            results.append((sorted((r.doc_id, r.class_id) for r in near.select("doc_id", "class_id").collect()),
                            sorted(r.doc_id for r in cp.keep_one_of_each(spark, read, SF).select("doc_id").collect())))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert results[0] == results[1] and 0 < len(results[0][1]) < 1000
