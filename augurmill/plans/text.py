"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from augurmill.operators import text as T
from augurmill.plans import models as PM
from augurmill.plans.registry import query
from augurmill.sources import fixtures as fx

PLACES = ("New York", "Chicago", "Springfield", "Los Angeles", "Denver", "Paris")
TURNS = ("above", "below", "exceed", "under", "")


def questions(spark, sf):
    """Weather questions for even customers, macro questions for the others, some unreadable."""
    k = F.col("c_custkey")
    weather = F.concat(F.lit("Will the high temperature in "), PM.pick(PLACES, k % 6), F.lit(" be "), PM.pick(TURNS, k % 5),
                       F.lit(" "), (k % 120 - 10).cast("string"), F.when(k % 4 == 0, "°F").when(k % 4 == 2, " degrees Celsius").otherwise(""), F.lit("?"))
    macro = F.concat(F.when(k % 3 == 0, "Will GDP growth print ").when(k % 3 == 1, "Will PCE inflation come in ").otherwise("Will the score be "),
                     F.when(k % 7 < 3, "below ").otherwise("above "), (k % 9).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("% this quarter?"))
    return fx.table(spark, sf, "customer").select(F.concat(F.lit("q"), k).alias("condition_id"), F.when(k % 2 == 0, weather).otherwise(macro).alias("question"))


@query
def question_spec(spark, sf):
    return T.question_spec(questions(spark, sf))


@query
def keyword_match(spark, sf):
    articles = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("title"))
    markets = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("condition_id"), F.col("text").alias("question"))
    return T.keyword_match(articles, markets)


@query
def article_dedup(spark, sf):
    """Two feeds: pages under their full address, and again under the address without query or anchor."""
    p = fx.table(spark, sf, "pages").select("page_id", "url")
    both = p.withColumn("feed", F.lit(1)).unionByName(p.withColumn("feed", F.lit(2)).withColumn("url", F.regexp_extract("url", r"^[^?#]*", 0)))
    return T.article_dedup(both, ["feed", "page_id"])


@query
def asof_articles(spark, sf):
    items = PM.evidence_items(spark, sf).groupBy("condition_id", "published_s").agg(F.count(F.lit(1)).alias("n"))
    return T.asof_articles(items, PM.evidence_states(spark, sf)).select("condition_id", "published_s", "forecast_s", "n")


def evidence_texts(spark, sf):
    """Extraction answers: one per line item, two evidence items each, sometimes wrapped, fenced or broken."""
    k, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    first = F.to_json(F.struct(
        F.concat(F.lit("claim "), part).alias("claim"),
        F.when(F.col("l_returnflag") == "A", "for_yes").when(F.col("l_returnflag") == "N", "for_no").otherwise("neutral").alias("direction"),
        (1 + line % 3).alias("strength"),
        (1 + F.col("l_suppkey") % 3 + (part % 50 == 0).cast("int") * 3).alias("source_reliability"),
        F.round(F.col("l_discount") * 10, 1).alias("relevance")))
    second = F.to_json(F.struct(F.lit("background").alias("claim"), F.lit("neutral").alias("direction"), F.lit(1).alias("strength"),
                                (1 + part % 3).cast("string").alias("source_reliability"), F.col("l_discount").alias("relevance"), line.alias("article_index")))
    listed = F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))
    text = (F.when(part % 5 == 0, F.concat(F.lit('{"items":'), listed, F.lit("}")))
            .when(part % 5 == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```")))
            .when(part % 5 == 2, F.concat(F.lit('{"other":'), listed, F.lit("}"))).otherwise(listed))
    return fx.table(spark, sf, "lineitem").select(
        k.alias("k"), F.when(part % 23 == 0, F.concat(text, F.lit("{"))).otherwise(text).alias("text"))


@query
def evidence_etl(spark, sf):
    """Per order: answers read, answers rejected, and what the accepted items weigh."""
    parsed = T.evidence_etl(evidence_texts(spark, sf))
    grade = F.aggregate("items", F.lit(0), lambda a, e: a + e["strength"] * e["source_reliability"])
    return parsed.groupBy("k").agg(
        F.count("items").alias("accepted"), F.count(F.when(F.col("items").isNull(), 1)).alias("rejected"),
        F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n_items"), F.coalesce(F.sum(grade), F.lit(0)).alias("grade"))


def postmortems(spark, sf):
    k = F.col("o_orderkey")
    source = F.concat(F.lit("source"), k % 6)
    body = F.when(k % 9 == 0, F.to_json(F.struct(F.concat(F.lit("note "), k).alias("notes")))).otherwise(
        F.to_json(F.struct(source.alias("error_source"), F.when(k % 4 == 0, F.concat(F.lit("note "), k)).alias("notes"))))
    return fx.table(spark, sf, "orders").select(
        k.alias("postmortem_id"), fx.epoch("o_orderdate").alias("ts_s"), F.when(F.col("o_custkey") % 3 == 0, "hit").otherwise("miss").alias("kind"),
        F.when(k % 31 == 0, F.concat(body, F.lit("}{"))).when(k % 31 == 1, "not json").otherwise(body).alias("analysis_json"))


@query
def lessons_digest(spark, sf):
    return T.lessons_digest(postmortems(spark, sf), 883612800)


@query
def lessons_notes(spark, sf):
    return T.lessons_notes(postmortems(spark, sf), 883612800)


@query
def pair_candidates(spark, sf):
    """Benchmark passages and documents against documents of the same language block."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("b_id"), F.lit("all").alias("block"), "text")
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("a_id"), F.lit("all").alias("block"), "text")
    known = fx.table(spark, sf, "labels").select((F.col("doc_id") % 40).alias("a_id"), F.col("doc_id").alias("b_id"))
    return T.pair_candidates(b, d, known, 0.4)
