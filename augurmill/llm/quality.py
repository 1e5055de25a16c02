"""Quality rules as a short-circuit cascade, in DataFrame functions throughout.

Every rule is a condition on the text or on its counts. On a small sample each
rule's run time and the share it rejects are measured, and the rules are chained in
one CASE by rejection per cost, so most bad texts meet a cheap rule first. The order
changes how much is computed, never the verdict. Nothing is shuffled and nothing
leaves the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import cut, llm_query, table

SPACE, WORD_CHAR, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
SAMPLE_ROWS = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more, by sorting the windows."""
    def windows(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.get(w, i).alias("a"),
                                F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), at)

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def starts(s: Column) -> Column:
        twin = lambda x, i: (((i > 0) & same(F.get(s, i - 1), x)) | ((i < F.size(s) - 1) & same(F.get(s, i + 1), x)))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def reach(acc: Column, i: Column) -> Column:
        return F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))

    found = let(F.sort_array(windows(words)), starts)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        F.aggregate(found, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), reach, lambda acc: acc["n"]))


def counts(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of a text, as one struct."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
    chars = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return F.struct(let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"))


#: Rule -> condition under which a text is rejected. Fixed values, after published web-text filters.
RULES: dict[str, str] = {
    "mean_word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 5 and 10 * n_dup_lines > 3 * n_lines",
    "shouting": "5 * length(regexp_replace(__text, '[^A-Z]+', '')) > 2 * word_chars",
    "no_letters": "5 * size(filter(split(__text, '[ \\\\x09-\\\\x0D]+'), x -> x rlike '[A-Za-z\\\\xC0-\\\\x{10FFFF}]')) < 3 * n_words",
}


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    own = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    c = own.withColumn("__c", counts(F.col("__text")))
    return c.select(*[f"__k{i}" for i in range(len(keep))], "__text", "__c.w.n_words", "__c.w.word_chars", "__c.n_symbols", "__c.l.n_dup_lines",
                    "__c.w.n_repeat_words", "__c.l.n_lines")


def rule_order(docs: DataFrame, rules: dict[str, str], rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejected share per measured second, on a bounded sample of rows."""
    sample = cut(counted(docs.limit(rows), []))
    n = max(1, sample.count())
    worth = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sample.where(F.expr(rule)).count()
        worth[name] = rejected / n / max(time.perf_counter() - began, 1e-3)
    return sorted(rules, key=lambda k: (-worth[k], k))


def quality(docs: DataFrame, rules: dict[str, str] | None = None, order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Counts and verdict of every text.

    One row per row of `docs` (`keep` columns, doc_id by default, and text): n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    `rejected_by`, the first rule in the cascade that rejects it ("base" for the base
    rule, null if kept). A null or empty text has no words, so the base rule rejects
    it. An empty table gives an empty table.
    """
    rules, kept = rules or RULES, keep or ["doc_id"]
    order = order or rule_order(docs, rules)
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    chain = F.when(F.expr(base), F.lit("base"))
    for name in order:
        chain = chain.when(F.expr(rules[name]), F.lit(name))
    out = counted(docs, kept).withColumn("__why", chain).withColumn("base_failed", F.expr(base))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", F.isnull("__why").alias("kept"), F.col("__why").alias("rejected_by"))


@llm_query
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality(table(spark, sf, "documents")).drop("rejected_by")
