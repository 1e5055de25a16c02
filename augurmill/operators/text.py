"""Questions, articles, evidence and candidate pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurmill.functions import exprs as X
from augurmill.session import scratch_path

# Question patterns, the city list, stopwords.
WEATHER = (r"(?i)(?:high|highest|max(?:imum)?)\s+temp(?:erature)?\s+in\s+([a-z .]+?)\s+"
           r"(?:be\s+)?(above|below|exceed|over|under)?\s*(-?\d+)\s*(?:°|degrees)?\s*(f|c|fahrenheit|celsius)?")
MACRO = {
    "GDPNOW": r"(?i)\bgdp\b.*?(-?\d+\.?\d*)\s*%",
    "PCENOW": r"(?i)\b(?:pce|personal consumption)\b.*?(-?\d+\.?\d*)\s*%",
}
BELOW = r"(?i)\b(below|under|less than)\b"
CITIES = ("nyc", "new york", "london", "chicago", "miami", "los angeles", "philadelphia", "washington",
          "atlanta", "dallas", "seattle", "denver")
STOPWORDS = ("will", "the", "a", "an", "by", "in", "on", "at", "of", "to", "be", "is",
             "before", "after", "than", "or", "and", "for", "with", "does", "do")
QUESTION_TOKEN = r"[A-Za-z][A-Za-z0-9'-]+"
TITLE_TOKEN = r"[a-z0-9'-]+"


def question_spec(questions: DataFrame) -> DataFrame:
    """City, series, direction, threshold and unit of weather and macro questions; others are dropped."""
    q = F.coalesce(F.col("question"), F.lit(""))
    part = {n: F.regexp_extract(q, WEATHER, n) for n in range(5)}
    city = F.lower(F.trim(part[1]))
    weather = (part[0] != "") & city.isin(*CITIES)
    series, number = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(MACRO.items()):
        hit = F.regexp_extract(q, pattern, 1)
        series = F.when(hit != "", F.lit(name)).otherwise(series)
        number = F.when(hit != "", hit).otherwise(number)
    direction = F.when(part[2] == "", "above").otherwise(F.lower(part[2]))
    unit = F.when((part[4] == "") | F.lower(part[4]).startswith("f"), "fahrenheit").otherwise("celsius")
    kind = F.when(weather, "weather").when(series.isNotNull(), "macro")
    return questions.withColumn("kind", kind).where("kind is not null").select(
        *questions.columns, "kind",
        F.when(weather, city).alias("city"), F.when(~weather, series).alias("series"),
        F.when(weather, part[3]).otherwise(number).cast("double").alias("threshold"),
        F.when(weather, unit).alias("unit"),
        F.when(weather, direction.isin("above", "exceed", "over")).otherwise(~q.rlike(BELOW)).cast("int").alias("above"))


def question_tokens(question: Column, first: int = 8) -> Column:
    words = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(QUESTION_TOKEN), F.lit(0)), F.lower)
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), 1, first)


def keyword_match(articles: DataFrame, markets: DataFrame, n: int = 20) -> DataFrame:
    """First n articles per market whose title shares one of its first eight keywords.

    Only the first n articles of a token can be among the first n of a market,
    so each token keeps n before the join and a common word stays small.
    """
    titles = (articles.select("article_id", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("title"), F.lit(TITLE_TOKEN), F.lit(0)))).alias("token")))
    per_token = Window.partitionBy("token").orderBy("article_id")
    heads = titles.withColumn("r", F.row_number().over(per_token)).where(F.col("r") <= n).select("token", "article_id")
    keys = markets.select("condition_id", F.explode(F.array_distinct(question_tokens(F.col("question")))).alias("token"))
    hits = keys.join(heads, "token").select("condition_id", "article_id").distinct()
    per_market = Window.partitionBy("condition_id").orderBy("article_id")
    return hits.withColumn("rank", F.row_number().over(per_market)).where(F.col("rank") <= n)


def article_dedup(articles: DataFrame, order: list[str]) -> DataFrame:
    """First article per URL."""
    rest = [c for c in articles.columns if c != "url"]
    return articles.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("a")).select("url", "a.*")


def asof_articles(articles: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Articles not dated after their forecast; undated ones stay."""
    return (articles.join(forecasts.select("condition_id", "forecast_s"), "condition_id")
            .where(F.col("published_s").isNull() | (F.col("published_s") <= F.col("forecast_s"))))


ITEM = "struct<claim:string,direction:string,strength:string,source_reliability:string,relevance:string,article_index:string>"
LIST_KEYS = ("items", "evidence", "results")


def whole_json(body: Column, kind: str) -> Column:
    """Parse a text that must be one JSON value and nothing after it.

    The reader stops at the end of the first value; inside brackets, trailing
    text makes the array malformed or longer than one.
    """
    one = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<{kind}>")
    return F.when(F.size(one) == 1, one[0])


def evidence_etl(raw: DataFrame) -> DataFrame:
    """`text` to an array of evidence items; null where anything breaks the schema.

    The schema allows a bare array or an object holding one under a known key.
    Values are read as text and cast, so a wrong type is seen rather than
    coerced. One bad item rejects the whole array. Each step is a column of its
    own: an expression written out wherever it is used reads the text anew each time.
    """
    body = F.col("__body")
    inner = F.regexp_replace(F.btrim(body, F.lit("`")), r"^(json)?\s+", "")
    is_list = body.startswith("[")
    boxed = F.concat(F.lit("["), body, F.lit("]"))
    wrapper = "struct<" + ",".join(f"{k}:array<{ITEM}>" for k in LIST_KEYS) + ">"
    read = (raw.withColumn("__body", F.btrim("text", F.lit(" \t\n\x0b\f\r")))
            .withColumn("__body", F.when(body.startswith("```"), inner).otherwise(body))
            .withColumn("__bare", F.when(is_list, F.from_json(boxed, f"array<array<{ITEM}>>")))
            .withColumn("__wrapped", F.when(~is_list, F.from_json(boxed, f"array<{wrapper}>"))))
    bare, wrapped = (F.when(F.size(c) == 1, F.col(c)[0]) for c in ("__bare", "__wrapped"))
    found = F.coalesce(bare, *[wrapped[k] for k in LIST_KEYS])

    def whole(x: Column) -> Column:
        return F.floor(x.try_cast("double")).cast("int")

    def ok(e: Column) -> Column:
        good = (e["direction"].isin("for_yes", "for_no", "neutral") & e["claim"].isNotNull()
                & e["strength"].between(1, 3) & e["source_reliability"].between(1, 3) & e["relevance"].between(0.0, 1.0))
        return F.coalesce(good, F.lit(False))

    clean = F.transform(found, lambda e: F.struct(
        e["claim"].alias("claim"), e["direction"].alias("direction"), whole(e["strength"]).alias("strength"),
        whole(e["source_reliability"]).alias("source_reliability"), e["relevance"].try_cast("double").alias("relevance"),
        F.coalesce(whole(e["article_index"]), F.lit(-1)).alias("article_index")))
    return (read.withColumn("__clean", clean).withColumn("items", F.when(F.forall("__clean", ok), F.col("__clean")))
            .drop("__body", "__bare", "__wrapped", "__clean"))


def lessons_digest(postmortems: DataFrame, since_s: int) -> DataFrame:
    """Error-source counts over misses of the window; unreadable analyses are skipped."""
    a = whole_json(F.col("analysis_json"), "struct<error_source:string,notes:string>")
    rows = postmortems.where(F.col("ts_s") >= since_s).withColumn("a", a).where("a is not null and kind = 'miss'")
    return rows.groupBy(F.coalesce("a.error_source", F.lit("unknown")).alias("error_source")).agg(F.count(F.lit(1)).alias("n"))


def lessons_notes(postmortems: DataFrame, since_s: int, n: int | None = None, chars: int | None = None) -> DataFrame:
    """The notes of the window, whole; a report asks for the first n of them, or for so many characters of each."""
    a = whole_json(F.col("analysis_json"), "struct<error_source:string,notes:string>")
    rows = postmortems.where(F.col("ts_s") >= since_s).withColumn("notes", a["notes"])
    rows = rows.where("notes is not null and notes <> ''")
    if n is not None:
        rows = rows.orderBy("ts_s", "postmortem_id").limit(n)
    notes = F.col("notes") if chars is None else F.substring("notes", 1, chars)
    return rows.select("postmortem_id", F.concat(F.lit("["), "kind", F.lit("] "), notes).alias("note"))


#: Counters of token frequencies: tokens that share one only make the order less sharp.
COUNTERS = 1 << 20


def token_sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, block, tokens, set_id): copies of a text, and texts of the same tokens, share a set_id."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return (df.select(F.col(id_col).alias("id"), "block", words.alias("tokens")).where(F.size("tokens") > 0)
            .withColumn("set_id", F.unhex(F.md5(F.array_join("tokens", " ").cast("binary")))))


def hashed(sets: DataFrame) -> DataFrame:
    return sets.select("set_id", "block", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a batch's sets one after the other, and the number of hashes of each set."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype("i8"), sizes


def token_counts(sets: DataFrame, only: np.ndarray | None = None) -> np.ndarray:
    """How many tokens of the sets fall on each counter: at most COUNTERS numbers, whatever the table; zero where `only` is."""
    def step(batches):
        own = np.zeros(COUNTERS, "i8")
        for b in batches:
            own += np.bincount(flat(b.column("h"))[0] % COUNTERS, minlength=COUNTERS)
        at = np.flatnonzero(own if only is None else own * (only > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["counter", "c"])

    total = sets.select("h").mapInArrow(step, "counter long, c long").groupBy("counter").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(COUNTERS, "i8")
    out[total["counter"].to_numpy("i8")] = total["c"].to_numpy("i8")
    return out


def set_prefixes(sets: DataFrame, rank, threshold: float, name: str, only=None) -> DataFrame:
    """Each set's first n - ceil(t*n) + 1 token hashes, rarest counters first; with `only`, those on its counters."""
    def step(batches):
        for b in batches:
            h, n = flat(b.column("h"))
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, rank.value[h % COUNTERS], owner))
            h, at = h[order], np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            use = at < (n - np.ceil(threshold * n - 1e-9) + 1)[owner]
            if only is not None:
                use &= only.value[h % COUNTERS] > 0
            who = pa.array(owner[use])
            yield pa.RecordBatch.from_arrays([b.column("set_id").take(who), b.column("block").take(who), pa.array(h[use]), pa.array(n[owner[use]].astype("i4"))],
                                             [f"{name}_set", "block", "token", f"{name}_n"])

    block = sets.schema["block"].dataType.simpleString()
    return sets.mapInArrow(step, f"{name}_set binary, block {block}, token long, {name}_n int")


def pair_candidates(a: DataFrame, b: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a_id, b_id) of one block whose token sets reach the Jaccard threshold; `a` is the smaller side.

    Exact, without comparing all pairs: tokens are put in one order, and two sets can only reach the threshold if
    they share a token among their first n - ceil(t*n) + 1. Tokens that `a` does not hold come first in it, then rare
    ones. The order comes from counters of fixed size, so a set finds its first tokens where it is read, and only those
    on counters of the prefixes of `a` are shuffled. Tokens are told apart by hashes until the pairs that meet are
    verified on the tokens themselves; only the sets among these are shuffled whole.
    """
    spark = a.sparkSession
    sa, sb = token_sets(a, "a_id", "text"), token_sets(b, "b_id", "text")
    ha, hb = hashed(sa), hashed(sb)
    own = token_counts(ha)
    rank = spark.sparkContext.broadcast(token_counts(hb, own) + own)
    pa_ = set_prefixes(ha, rank, threshold, "a").distinct()
    met = spark.sparkContext.broadcast(token_counts(pa_.select(F.array("token").alias("h"))))
    pb = set_prefixes(hb, rank, threshold, "b", met)
    shared = (pb.join(pa_, ["block", "token"])
              .where((F.col("b_n") >= F.lit(threshold) * F.col("a_n") - 1e-9) & (F.col("a_n") >= F.lit(threshold) * F.col("b_n") - 1e-9))
              .select("block", "a_set", "b_set").distinct())
    at = scratch_path(spark, "pair-candidates")
    shared.write.parquet(at)  # the planner knows its size then
    shared = spark.read.schema(shared.schema).parquet(at)

    def whole(s: DataFrame, name: str) -> DataFrame:
        found = s.select(F.col("set_id").alias(f"{name}_set"), "block", F.col("tokens").alias(f"{name}_tokens"))
        return found.join(shared.select("block", f"{name}_set").distinct(), ["block", f"{name}_set"], "left_semi").dropDuplicates(["block", f"{name}_set"])

    inter = F.size(F.array_intersect("a_tokens", "b_tokens"))
    score = inter / (F.size("a_tokens") + F.size("b_tokens") - inter)
    scored = (shared.join(whole(sa, "a"), ["a_set", "block"]).join(whole(sb, "b"), ["b_set", "block"]).withColumn("score", score)
              .where(F.col("score") >= threshold - 1e-12).select("block", "a_set", "b_set", "score"))
    at = scratch_path(spark, "pairs")
    scored.write.parquet(at)
    scored = spark.read.schema(scored.schema).parquet(at)
    members_a = sa.select(F.col("set_id").alias("a_set"), "block", F.col("id").alias("a_id"))
    members_b = sb.select(F.col("set_id").alias("b_set"), "block", F.col("id").alias("b_id"))
    return (scored.join(members_a, ["a_set", "block"]).join(members_b, ["b_set", "block"])
            .select("a_id", "b_id", "score").join(known.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti"))
