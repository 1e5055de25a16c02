"""Personal data: exact patterns, and identifiers that their contexts give away.

**Base.** E-mail addresses, IP addresses, payment cards and phone numbers by pattern
and check.

**Bootstrapping.** The base's finds are seed instances. The two words before an
instance are its context, a lexical pattern. Every other identifier-like string (at least four
digits and six characters) is a candidate instance of its own context. On the graph of
patterns and instances, Spark scores in turn: a pattern by the mean score of its
distinct instances, an instance by the chance that one of its patterns is right;
seeds stay at 1. Patterns that at least `support` different seeds back and that score
`confidence` or more turn their candidates into finds. The graph is small beside the texts and
is joined and aggregated as tables; finds go back to the texts by digest, so one row for a
text serves all its copies.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, cut, llm_query, table

KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails at the first digit of a run fails at the others too
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMERIC = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
CONTEXT_CHARS = 80


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs: a match opens at the first character of the run before its sign."""
    found, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            found.append(m.span())
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    spans = [(0, *s) for s in emails(text)]
    if not _NUMERIC.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((3, *m.span()))
    return spans


def context(text: str, start: int) -> str:
    """The two words before, lower-cased."""
    return " ".join(text[max(0, start - CONTEXT_CHARS):start].lower().split()[-2:])


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates of a text with their contexts."""
    found = [{"start": s, "end": e, "context": context(text, s), "seed": True, "what": text[s:e]} for _, s, e in spans]
    if _NUMERIC.search(text):
        taken = sorted((s, e) for _, s, e in spans)
        for m in _TOKEN.finditer(text):
            if not _NUMERIC.search(m[0]):
                continue
            own = m[0].rstrip(".,;:!?)")
            s, e = m.start(), m.start() + len(own)
            if len(own) >= 6 and sum(c.isdigit() for c in own) >= 4 and not any(a < e and s < b for a, b in taken):
                found.append({"start": s, "end": e, "context": context(text, s), "seed": False, "what": own})
    return [x for x in found if x["context"]]


_ITEM = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("seed", pa.bool_()), ("what", pa.string())])
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def scored_patterns(graph: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """context: the patterns to trust. `graph`: distinct context, what, seed."""
    edges = cut(graph.groupBy("context", "what").agg(F.max("seed").alias("seed")))
    patterns = edges.groupBy("context").agg(F.avg(F.col("seed").cast("double")).alias("score"), F.count_if("seed").alias("seeds"))
    for _ in range(rounds):
        # 1 - product over patterns, as a sum of logarithms
        unseeded = edges.where("not seed").join(patterns.where(F.col("seeds") >= support), "context")
        found = unseeded.groupBy("what").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("own"))
        each = edges.join(found, "what", "left").withColumn("own", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0))))
        patterns = cut(each.groupBy("context").agg(F.avg("own").alias("score"), F.count_if("seed").alias("seeds")))
    return patterns.where((F.col("seeds") >= support) & (F.col("score") >= confidence)).select("context")


def personal_data(docs: DataFrame, keep: list[str] | None = None, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Personal data in every text.

    One row per row of `docs` (`keep` columns, doc_id by default, and text): base_spans and found_spans (arrays of kind,
    start, end; kinds number KINDS; code points, end exclusive). Found spans have kind "id" and do not overlap base
    spans. A null or empty text has none. An empty table gives an empty table. `docs` is read twice.
    """
    kept = keep or ["doc_id"]

    def step(batches):
        for b in batches:
            own = [x or "" for x in b.column("text").to_pylist()]
            base = [base_spans(x) for x in own]
            items = [instances(x, s) for x, s in zip(own, base)]
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in base]
            columns = [b.column(f"__k{i}") for i in range(len(kept))] + [b.column("__digest"), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(_ITEM))]
            yield pa.RecordBatch.from_arrays(columns, [*(f"__k{i}" for i in range(len(kept))), "__digest", "base_spans", "items"])

    types = "".join(f"__k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    own = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("__digest"))
    out = arrow_map(own, step, types + "__digest string, base_spans array<struct<kind: int, start: int, end: int>>, "
                    "items array<struct<start: int, end: int, context: string, seed: boolean, what: string>>")
    items = cut(out.where(F.size("items") > 0).select("__digest", F.explode("items").alias("i")).select("__digest", "i.*").distinct())
    trusted = scored_patterns(items.select("context", "what", "seed"), rounds, support, confidence)
    found = (items.where("not seed").join(trusted, "context").groupBy("__digest")
             .agg(F.array_sort(F.collect_set(F.struct(F.lit(len(KINDS) - 1).alias("kind"), "start", "end"))).alias("found_spans")))
    found = found.withColumnRenamed("__digest", "__d")
    full = out.drop("items").join(found, F.col("__digest") == F.col("__d"), "left")
    return full.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "base_spans",
                       F.coalesce("found_spans", F.array().cast("array<struct<kind: int, start: int, end: int>>")).alias("found_spans"))


def redacted(found: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of `__row`, its text with the spans (sorted by start) replaced by their kinds; overlapping spans merge into the first.

    A null text stays null. n_chars, if there is one, becomes the new text's length.
    """
    def piece(acc: Column, s: Column) -> Column:
        name = F.concat(F.lit("["), F.upper(F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])), F.lit("]"))
        fresh = s["start"] >= acc["at"]
        text = F.when(fresh, F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), name)).otherwise(acc["text"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    whole = F.aggregate("spans", start, piece, lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    new = found.withColumn("__text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
    special = {"text": F.col("__text"), "n_chars": F.when(F.size("spans") > 0, F.length("__text").cast("long")).otherwise(F.col("__row")["n_chars"].cast("long")) if "n_chars" in columns else None}
    return new.select(*[(special[c] if c in special else F.col("__row")[c]).alias(c) for c in columns])


def written_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@llm_query
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    out = personal_data(table(spark, sf, "documents"))
    number = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[number(k) for k in range(4)], F.sha2(written_spans(F.col("base_spans")), 256).alias("base_sha256"),
                      written_spans(F.concat("base_spans", "found_spans")).alias("spans"))
