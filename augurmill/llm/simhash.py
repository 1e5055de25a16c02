"""SimHash fingerprints and the search for fingerprints within a Hamming radius, in DataFrame functions throughout.

**Fingerprints.** The terms of a text are its first word and its pairs of neighbouring words. Every occurrence
of a term votes on each bit of the fingerprint with the sign that the term's hash has there, weighted by the
term's length: long words tell texts apart better than short ones. A bit is set where the votes for it outweigh
those against it, so the share of differing bits estimates the angle between two bags of weighted terms. The
votes are added up for blocks of 2048 terms first, where one sum holds those of four bits. Terms that a text
and its edited text have in common are made and counted once.

**Neighbours.** A text is compared with the text of the next id. Rows are dealt to slices of neighbouring ids,
whose bounds are ids of the table, and the first row of each slice also goes to the slice before it. One
shuffle of the texts is all: terms, votes and both comparisons stay where the slice lies.

**Search.** A fingerprint is cut into blocks. Two that differ in at most `radius` bits agree in all blocks but
`radius`; so there is a table for each choice of `blocks - radius` blocks, keyed by these blocks, in which
they meet. Only different fingerprints are kept in the tables, with the number of their rows; a pair counts in
the first of the tables it meets in.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurmill.llm.common import llm_query, stored, table

SPACE, LAST_SPACE = r"[\x20\x09-\x0D]+", r"(?s)^.*[\x20\x09-\x0D]"
BITS, RADIUS, BLOCKS = 128, 6, 8
#: Weight of a term: its characters, at most so many. A block's weight stays below 2 ** 15.
MOST_WEIGHT, BLOCK_TERMS = 15, 2048
#: Rows of a slice, and the most slices that one plan tells apart; beyond that slices grow.
SLICE_ROWS, MOST_SLICES = 500, 1 << 16
#: Bounds that one step of the search for a row's slice looks through.
STRIDE = 256
LOW = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def terms(own: Column, before: Column) -> Column:
    """Hash and weight of every word with the word before it; before the first stands `before`, null at a text's start."""
    def term(w: Column, i: Column) -> Column:
        last = F.coalesce(F.get(own, i - 1), before)
        return F.struct(F.xxhash64(last, w).alias("h"), F.least(F.length(w) + F.coalesce(F.length(last), F.lit(0)), F.lit(MOST_WEIGHT)).alias("w"))

    return F.transform(own, term)


def sections(text: Column, edited: Column, common: Column) -> Column:
    """Terms in the words that both texts have before the last space of their common start (0), and in what follows
    in the text (1) and in its edited text (2)."""
    start = F.length(common) + 1

    def of(first: Column) -> Column:
        rest = lambda x: let(words(F.substr(x, start)), lambda w: terms(w, F.get(first, F.size(first) - 1)))
        each = terms(first, F.lit(None).cast("string")), rest(text), rest(edited)
        return F.array(*[F.struct(F.lit(i).alias("section"), t.alias("terms")) for i, t in enumerate(each)])

    return let(words(common), of)


def parts_of(bits: int) -> range:
    return range(bits // 64)


def votes(bits: int) -> list[Column]:
    """Sums over terms (h, w) that hold the weights for bits i, i + 16, i + 32 and i + 48 of each 64 bits, 16 bits each."""
    own = {part: "h" if part == 0 else f"xxhash64(h, {part})" for part in parts_of(bits)}
    return [F.expr(f"sum((shiftrightunsigned({own[part]}, {i}) & {0x0001000100010001}) * w)").alias(f"v{part}_{i}") for part in parts_of(bits) for i in range(16)]


def ballots(bits: int) -> list[Column]:
    """Over the blocks of a text: sums that hold the weights for bits i and i + 32, 32 bits each."""
    return [F.expr(f"sum(shiftrightunsigned(coalesce(v{part}_{i % 16}, 0), {i // 16 * 16}) & {0x0000FFFF0000FFFF})").alias(f"s{part}_{i}") for part in parts_of(bits) for i in range(32)]


def fingerprint(bits: int) -> list[Column]:
    """The words of the fingerprint, 64 bits each: the bits for which there is more than half of the weight."""
    def bit(part: int, i: int) -> str:
        weight = f"shiftrightunsigned(s{part}_{i % 32}, {i // 32 * 32}) & {0xFFFFFFFF}"
        return f"shiftleft(cast(coalesce(2 * ({weight}) > total, false) as bigint), {i})"

    return [F.expr(" | ".join(bit(part, i) for i in range(64))).alias(f"f{part}") for part in parts_of(bits)]


def distance(a: list[Column], b: list[Column]) -> Column:
    """Bits in which two fingerprints differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:])), F.bit_count(a[0].bitwiseXOR(b[0])))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Estimated cosine of two texts' weighted terms, 0 to 1: that of the angle in which the share of bits differs."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * (math.pi / (64 * len(a)))))


def _bounds(ids: DataFrame, slice_rows: int) -> list[int]:
    """First ids of the slices, ascending; ids of the table, found by a mergeable sketch."""
    n = ids.count()
    k = min(MOST_SLICES, -(-n // slice_rows))
    if k == 0:
        return []
    shares = [i / k for i in range(1, k)]
    row = ids.agg(F.min("key").alias("low"), F.percentile_approx("key", shares or [0.5], max(10_000, 20 * k)).alias("cuts")).first()
    return sorted({row["low"], *(row["cuts"] if shares else [])})


def _slice(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that is not above the key: first among strides of bounds, then within one."""
    last = lambda among: F.size(F.filter(among, lambda b: b <= key)) - 1
    literals = lambda numbers: F.array(*[F.lit(b) for b in numbers])
    if len(bounds) <= STRIDE:
        return last(literals(bounds))
    strides = F.array(*[literals(bounds[i:i + STRIDE]) for i in range(0, len(bounds), STRIDE)])
    at = last(literals(bounds[::STRIDE]))
    return at * STRIDE + last(F.get(strides, at))


def fingerprints(docs: DataFrame, bits: int = BITS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    The edited text: the last quarter of the characters (floor) is replaced by as many of the first characters of
    the next text, or all it has. Next is the next greater doc_id (a whole number), after the last the first; rows
    of one doc_id follow by their text; a null doc_id comes before all. A table of one row is its own neighbour.

    One row per row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, f0, f1 ... and e0, e1 ... (64 bits
    each of both fingerprints), near_edited, near_next. A null text is the empty text, whose bits are all zero, as
    are those of a text without words. Equal texts have equal fingerprints. An empty table gives an empty table.
    """
    if bits % 64 or bits < 64:
        raise ValueError("bits must be a multiple of 64")
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = _bounds(own.select("key"), slice_rows) or [LOW]
    n = len(bounds)
    first = F.col("key") == F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("slice") + 1)
    twice = F.array(F.struct(F.col("slice").alias("s"), F.lit(False).alias("c")), F.struct(F.pmod(F.col("slice") - 1, F.lit(n)).alias("s"), F.lit(True).alias("c")))
    dealt = own.withColumn("slice", _slice(F.col("key"), bounds)).withColumn("at", F.explode(F.when(first, twice).otherwise(F.slice(twice, 1, 1))))
    in_order = Window.partitionBy("slice").orderBy("copy", "key", "text")
    rows = (dealt.select("doc_id", "key", "text", F.col("at.s").alias("slice"), F.col("at.c").alias("copy"))
            .withColumns({"following": F.lead("text").over(in_order), "row": F.row_number().over(in_order)}))
    chars = F.length("text")
    cut = F.floor(chars / 4).cast("int")
    # a copy's own edited text is not asked for
    edited = F.when(F.col("copy"), F.lit("")).otherwise(F.concat(F.left("text", chars - cut), F.left(F.coalesce("following", F.lit("")), cut)))
    rows = rows.select("doc_id", "slice", "row", "copy", chars.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.regexp_extract(F.left("text", chars - cut), LAST_SPACE, 0).alias("common"))
    key = ["slice", "row", "doc_id", "copy", "n_chars", "edited_sha256"]
    voters = (rows.select("slice", "row", "doc_id", "copy", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"), F.explode(sections(F.col("text"), F.col("edited"), F.col("common"))).alias("x"))
              .select(*key, "x.section", F.posexplode_outer("x.terms").alias("at", "t")).select(*key, "section", F.floor(F.col("at") / BLOCK_TERMS).alias("block"), F.col("t.h").alias("h"), F.col("t.w").cast("long").alias("w")))
    blocks = voters.groupBy(*key, "section", "block").agg(F.sum("w").alias("total"), *votes(bits))
    # the terms before the last common space belong to the text and to its edited text
    sides = F.when(F.col("section") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("section") - 1))
    summed = blocks.withColumn("side", F.explode(sides)).groupBy(*key, "side").agg(F.sum("total").alias("total"), *ballots(bits))
    k = bits // 64
    folded = (summed.select(*key, "side", *fingerprint(bits)).groupBy(*key)
              .agg(*[F.max(F.when(F.col("side") == s, F.col(f"f{i}"))).alias(f"{name}{i}") for s, name in ((0, "f"), (1, "e")) for i in range(k)]))
    after = Window.partitionBy("slice").orderBy("row")
    beside = folded.withColumns({f"n{i}": F.lead(f"f{i}").over(after) for i in range(k)}).where("not copy")
    cols = lambda name: [F.col(f"{name}{i}") for i in range(k)]
    return beside.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), *cols("f"), *cols("e"),
                         likeness(cols("f"), cols("e")).alias("near_edited"), likeness(cols("f"), cols("n")).alias("near_next"))


def as_text(words: list[Column]) -> Column:
    """A fingerprint as lower-case hexadecimal digits, 16 for each of its words."""
    return F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in words])


def _block(words: list[Column], bits: int, i: int, blocks: int) -> Column:
    """Bits of block i. A block that crosses into the next word takes its bits from both."""
    low, high = bits * i // blocks, bits * (i + 1) // blocks
    parts = []
    for w in range(low // 64, (high - 1) // 64 + 1):
        a, b = max(low, 64 * w) - 64 * w, min(high, 64 * w + 64) - 64 * w
        part = F.shiftrightunsigned(words[w], a)
        parts.append(part if b - a == 64 else part.bitwiseAND(F.lit((1 << (b - a)) - 1)))
    return parts[0] if len(parts) == 1 else F.struct(*parts)


def within_radius(found: DataFrame, query: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All other fingerprints within `radius` differing bits of those that have a row for which `query` holds.

    `found` has the columns f0, f1 ...; others are left out of account. One row per queried fingerprint: f0, f1 ...,
    n_same (rows that have it), n_near (rows of the other fingerprints within the radius). Nothing is lost: see
    the head of the module. Rows with the same fingerprint, however many, are one row in the tables.
    """
    names = sorted((c for c in found.columns if c[:1] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    bits = 64 * len(names)
    if not 0 < radius < blocks <= bits:
        raise ValueError("blocks must be more than radius, and at most the bits")
    kinds = stored(found.groupBy(*names).agg(F.count("*").alias("n"), F.max(F.coalesce(query, F.lit(False))).alias("asked")), "fingerprints")
    chosen = list(itertools.combinations(range(blocks), blocks - radius))
    own = [F.col(c) for c in names]
    keys = F.array(*[F.xxhash64(F.lit(t), *[_block(own, bits, i, blocks) for i in sets]) for t, sets in enumerate(chosen)])
    index = kinds.select(*names, "n", F.posexplode(keys).alias("t", "key"))
    asked = kinds.where("asked").select(*[F.col(c).alias(f"q{c}") for c in names], F.posexplode(keys).alias("qt", "key"))
    mine, theirs = [F.col(f"q{c}") for c in names], own
    # where two agree, the first choice of blocks among those in which they do is theirs alone
    agree = [(_block(mine, bits, i, blocks) == _block(theirs, bits, i, blocks)).cast("int") for i in range(blocks)]
    kept = F.filter(F.array(*[F.when(a == 1, F.lit(i)).otherwise(F.lit(-1)) for i, a in enumerate(agree)]), lambda x: x >= 0)
    first = F.slice(kept, 1, blocks - radius) == F.element_at(F.array(*[F.array(*[F.lit(i) for i in sets]) for sets in chosen]), F.col("t") + 1)
    apart = distance(mine, theirs)
    pairs = asked.join(index, "key").where((F.col("t") == F.col("qt")) & (apart > 0) & (apart <= radius)).where(first)
    near = pairs.groupBy(*[f"q{c}" for c in names]).agg(F.sum("n").alias("n_near"))
    same = kinds.where("asked").select(*[F.col(c).alias(f"q{c}") for c in names], F.col("n").alias("n_same"))
    out = same.join(near, [f"q{c}" for c in names], "left")
    return out.select(*[F.col(f"q{c}").alias(c) for c in names], "n_same", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


@llm_query
def op11_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document, and for ids divisible by 50 the documents of the same fingerprint, itself
    left out, and those of others within the radius (null for other ids)."""
    found = stored(fingerprints(table(spark, sf, "documents")), "fingerprinted")
    f, e = ([F.col(f"{name}{i}") for i in range(BITS // 64)] for name in "fe")
    asked = F.col("doc_id") % 50 == 0
    near = within_radius(found, asked)
    # only rows that are asked for go through the join: copies of one text may be many
    own = found.where(asked).join(near, [f"f{i}" for i in range(BITS // 64)], "left")
    rest = found.where(F.coalesce(~asked, F.lit(True))).withColumns({"n_same": F.lit(None).cast("long"), "n_near": F.lit(None).cast("long")})
    out = own.unionByName(rest)
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(f).alias("fingerprint"), as_text(e).alias("edited_fingerprint"), "near_edited", "near_next",
                      (F.col("n_same") - 1).alias("n_same"), "n_near")
