"""Near-duplicate documents by weighted similarity of their bags of five-word shingles.

**Signatures** (BagMinHash). Every shingle owns a Poisson process for each dyadic
interval [0,1), [1,2), [2,4) ... of weights, drawn from its hash, whose rate is the
interval's length. A point carries a time, a register and a position among the
weights of its interval; it counts for a text whose bag holds the shingle more often
than that position, so all texts thin the same points. The first point to reach a
register is its signature; two texts agree in a register with the probability of
their weighted Jaccard similarity. Times run to a bound that fills all registers of
almost every text; it doubles for the others, so a signature is always exact.

**Candidates.** Texts with equal bags are one node. Nodes meet where a band of
registers agrees. Each meeting place links its members to its least member, a star,
not all pairs, and then each of a few drawn centres to the members of other classes.
That only spares work: members of the places that still hold different classes go
through an exact join. Their bags are put in one order, rarest shingles first, and two
bags that are similar enough share a shingle of their prefixes whose positions leave
room for the overlap. So every link between those members is found, whatever the size
of their places, unless a chain of links has replaced it.

A candidate becomes a row only if the sketches of both bags allow the similarity: each
bit in which they differ is a shingle that only one of them holds. So a large group of
texts that are a little too different makes few rows, and no link is lost by it.

**Classes.** Candidates are verified on the bags; connected components come from
label steps on the classes, on tables. Bags are made only for candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, mix, stored, table, texts, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands with probability (1 - 0.8 ** ROWS) ** BANDS, 7 in 10,000.
BANDS, ROWS = 24, 6
#: Centres that a meeting place gets in a round before the exact join, the rounds at most, and the share of the members
#: that a round must link for the next one.
CENTRES, ROUNDS, WORTH = 4, 4, 0.02
#: Counters of the shingles' frequencies, which order the bags; shingles that share one only make the order less sharp.
COUNTERS = 1 << 20
#: Rows of one shingle that one task joins with all rows of it.
SALT_ROWS = 2000
#: Shingles before its own that a prefix row carries, so that pairs which met at one of them don't meet again.
RECENT = 8
#: Bits of the sketch of a bag; a bit is the parity of the bag's shingles that fall on it.
SKETCH_BITS = 1024
#: Bytes of text that are signed at once.
BATCH_BYTES = 1 << 21


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that every Python process agrees on."""
    local: dict[bytes, int] = {}
    ids = np.fromiter((local.setdefault(w, len(local)) for w in words), "i8", len(words))
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in local), "u8", len(local))[ids]


def bags(batch_texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles of each text, in order. A shorter text is one shingle."""
    split = [words_of(x) for x in batch_texts]
    lengths = np.array([len(x) for x in split], "i8")
    h = word_hashes([w for x in split for w in x])
    k = np.minimum(lengths, shingle)
    n = np.where(lengths > 0, lengths - k + 1, 0)
    doc = np.repeat(np.arange(len(split)), n)
    if not len(doc):
        return doc, np.zeros(0, "u8"), np.zeros(0, "i8")
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(lengths) - lengths, n)
    own, s = k[doc], np.zeros(len(doc), "u8")
    for j in range(shingle):
        s = np.where(j < own, mix(s * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + j, len(h) - 1)]), s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])])
    first = np.flatnonzero(new)
    return doc[first], s[first], np.diff(np.append(first, len(doc)))


def occurrences(doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 32-bit hash of every occurrence of a shingle, so that bags overlap like sets."""
    each = np.repeat(np.arange(len(h)), weight)
    turn = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
    return doc[each], (mix(h[each] + turn.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


def sketches(owner: np.ndarray, values: np.ndarray, texts_n: int) -> np.ndarray:
    """SKETCH_BITS for each text, as 64-bit numbers."""
    counts = np.bincount(owner * SKETCH_BITS + values.astype("i8") % SKETCH_BITS, minlength=texts_n * SKETCH_BITS)
    return np.packbits((counts % 2).astype(bool).reshape(texts_n, SKETCH_BITS), axis=1, bitorder="little").view("<i8")


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="i4") * values.shape[1]), pa.array(values.reshape(-1)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts_n: int, registers: int) -> np.ndarray:
    """For each text the hashes of the first points to reach its registers; texts without shingles keep zeros."""
    best, sig = np.full(texts_n * registers, np.inf), np.zeros(texts_n * registers, "u8")
    total = np.bincount(doc, weight, texts_n)
    bound = np.where(total > 0, registers * (math.log(registers) + 3) / np.maximum(total, 1), 0)
    levels = [np.zeros(len(h), "i8")]
    which = [np.arange(len(h))]
    k = 1
    while len(deep := np.flatnonzero(weight > (1 << (k - 1)))):  # interval [2 ** (k - 1), 2 ** k)
        which.append(deep)
        levels.append(np.full(len(deep), k))
        k += 1
    unit, level = np.concatenate(which), np.concatenate(levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype("f8")
    state = mix(h[unit] ^ mix(level.astype("u8") + np.uint64(0x51ED270B)))
    owner, room = doc[unit], weight[unit]
    time = np.zeros(len(unit))

    def advance(i: np.ndarray) -> None:
        state[i] = mix(state[i] + np.uint64(0x9E3779B97F4A7C15))
        time[i] += -np.log1p(-((state[i] >> np.uint64(11)).astype("f8") * 2.0**-53)) / rate[i]

    live = np.arange(len(unit))
    advance(live)
    while len(live):
        now = live[time[live] < bound[owner[live]]]
        while len(now):
            more = mix(state[now] ^ np.uint64(0xD6E8FEB86659FD93))
            place = low[now] + (((more >> np.uint64(40)).astype("f8") * 2.0**-24) * rate[now]).astype("i8")
            use = now[place < room[now]]
            slot = owner[use] * registers + (mix(state[use] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype("i8")
            better = time[use] < best[slot]
            use, slot = use[better], slot[better]
            np.minimum.at(best, slot, time[use])
            won = time[use] == best[slot]
            sig[slot[won]] = state[use[won]]
            advance(now)
            now = now[time[now] < bound[owner[now]]]
        empty = np.isinf(best.reshape(texts_n, registers)).any(1) & (total > 0)
        bound = np.where(empty, bound * 2, 0)
        live = live[empty[owner[live]]]
    return sig.reshape(texts_n, registers)


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, __uid, __key, digest (128 bits of the bag; null without words), size (of the bag), one hash for each band, sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batches):
        for b in batches:
            own = texts(b)
            doc, h, weight = bags(own, shingle)
            sig = signatures(doc, h, weight, len(own), bands * rows)
            acc = np.zeros((len(own), bands), "u8")
            for r in range(rows):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(len(own), bands, rows)[:, :, r])
            acc = mix(acc + np.arange(bands, dtype="u8")).astype("i8")
            digest = np.zeros((len(own), 2), "u8")
            for k in range(2):
                np.add.at(digest[:, k], doc, mix(h * np.uint64(2 * k + 3) + mix(weight.astype("u8") + np.uint64(k))))
            some = np.bincount(doc, minlength=len(own)) > 0
            raw = [digest[i].tobytes() if some[i] else None for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__uid"), b.column("__key"), pa.array(raw, pa.binary()), pa.array(np.bincount(doc, weight, len(own)).astype("i8")), lists(acc),
                                              lists(sketches(*occurrences(doc, h, weight), len(own)))], ["doc_id", "__uid", "__key", "digest", "size", "bands", "sketch"])

    return arrow_map(docs, step, f"doc_id {kind}, __uid long, __key binary, digest binary, size long, bands array<long>, sketch array<long>", BATCH_BYTES)


def row_key() -> Column:
    """128 bits of doc_id and text. Unlike a row's number it is the same in every reading of a table."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))).cast("binary")))


def bag_table(docs: DataFrame, shingle: int) -> DataFrame:
    """node (__uid) and its bag: sorted 32-bit hashes, one for each occurrence, so that bags overlap like sets."""
    def step(batches):
        for b in batches:
            own = texts(b)
            doc, h, weight = bags(own, shingle)
            owner, values = occurrences(doc, h, weight)
            values = values[np.lexsort((values, owner))]
            ends = np.cumsum(np.bincount(owner, minlength=len(own)))
            raw = [values[e - n:e].tobytes() for e, n in zip(ends.tolist(), np.bincount(owner, minlength=len(own)).tolist())]
            yield pa.RecordBatch.from_arrays([b.column("__uid"), pa.array(raw, pa.binary())], ["node", "bag"])

    return arrow_map(docs.select("__uid", "text"), step, "node long, bag binary", BATCH_BYTES)


def similarity(a: bytes, b: bytes, least: float = 0.0) -> float:
    """Weighted Jaccard similarity of two bags; 0 where their sizes alone keep it below `least`."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if min(len(x), len(y)) < (least - 1e-6) * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 0.0


def verified(pairs: DataFrame, bag: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose bags are at least so similar."""
    full = (pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
            .join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b"))

    def step(batches):
        for b in batches:
            good = [similarity(x, y, least) >= least for x, y in zip(b.column("bag_a").to_pylist(), b.column("bag_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], ["a", "b"])

    return stored(arrow_map(full.select("a", "b", "bag_a", "bag_b"), step, "a long, b long"))


def alike(x: str, y: str, least: float) -> Column:
    """Whether bags of these sizes can be so similar: they overlap in the smaller one at most."""
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-6


def near(x: str, y: str, sketch_x: str, sketch_y: str, least: float) -> Column:
    """Whether bags of these sizes and sketches can be so similar: then few shingles are in one of them only."""
    apart = sum(F.bit_count(F.col(sketch_x)[k].bitwiseXOR(F.col(sketch_y)[k])) for k in range(SKETCH_BITS // 64))
    return apart <= (1 - least) / (1 + least) * (F.col(x) + F.col(y)) + 1e-6


def by_class(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different classes, with the classes."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where("la <> lb")


def hooked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels one step on: of two linked classes (la, lb) the one of the greater label takes the least label next to it,
    or the label that this one takes. At least half of the classes that have a link are gone after it."""
    ends = F.explode(F.array(F.struct(F.col("la").alias("label"), F.col("lb").alias("near")), F.struct(F.col("lb").alias("label"), F.col("la").alias("near"))))
    low = links.select(ends.alias("e")).groupBy("e.label").agg(F.min("e.near").alias("near")).where("near < label")
    then = low.select(F.col("label").alias("near"), F.col("near").alias("far"))
    new = low.join(then, "near", "left").select("label", F.coalesce("far", "near").alias("new"))
    return stored(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links: classes joined by a chain of links have the least of their labels. Settled links are left."""
    while True:
        links = stored(by_class(links.select("a", "b"), labels))
        if links.isEmpty():
            return labels
        labels = hooked(labels, links)


def unsettled(places: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their classes, of the places whose members are in different classes. A settled place stays so."""
    own = places.select("band", "node", "size", "sketch").join(labels, "node")
    mixed = own.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    return stored(own.join(mixed, "band"))


def other_centres(places: DataFrame, turn: int, centres: int, least: float) -> DataFrame:
    """In each place: pairs of a centre and the members of other classes. This turn's hashes draw classes, then a member
    of each, so that a small class beside a large one gets its turn."""
    member = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("size").alias("other"), F.col("sketch").alias("drawn"))).alias("c")
    ranked = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("la", F.lit(turn)), "la")).alias("rank")
    drawn = places.groupBy("band", F.col("label").alias("la")).agg(member).select("band", "la", "c.a", "c.other", "c.drawn", ranked).where(F.col("rank") <= centres)
    return places.join(drawn, "band").where((F.col("label") != F.col("la")) & alike("size", "other", least) & near("size", "other", "sketch", "drawn", least)).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def frequencies(bag: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur: at most COUNTERS numbers, whatever the table."""
    def step(batches):
        own = np.zeros(COUNTERS, "i8")
        for b in batches:
            for raw in b.column("bag").to_pylist():
                np.add.at(own, np.frombuffer(raw, "<u4") % COUNTERS, 1)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["counter", "c"])

    total = arrow_map(bag.select("bag"), step, "counter long, c long").groupBy("counter").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(COUNTERS, "i8")
    out[total["counter"].to_numpy("i8")] = total["c"].to_numpy("i8")
    return out


def prefixes(bag: DataFrame, least: float) -> DataFrame:
    """node, its size, and the shingles of its prefix with their positions, rarest first; `low` marks those at which it
    can be the smaller bag of a pair, `recent` are the last shingles before; and the bag's sketch."""
    rank = bag.sparkSession.sparkContext.broadcast(frequencies(bag))

    def step(batches):
        for b in batches:
            for node, raw in zip(b.column("node").to_pylist(), b.column("bag").to_pylist()):
                own = np.frombuffer(raw, "<u4")
                n = len(own)
                sketch = sketches(np.zeros(n, "i8"), own, 1)
                own = own[np.lexsort((own, rank.value[own % COUNTERS]))]
                far = n - math.ceil(least * n - 1e-6) + 1
                low = n - math.ceil(2 * least / (1 + least) * n - 1e-6) + 1
                own = own[:far]
                own, at = own.astype("i8"), np.arange(len(own))
                before = np.minimum(at, RECENT)
                ends = np.cumsum(before)
                recent = own[np.repeat(at - before, before) + np.arange(before.sum()) - np.repeat(ends - before, before)]
                last = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype("i4")), pa.array(recent))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node)), pa.array(np.full(len(own), n)), pa.array(own), pa.array(at), pa.array(at < low), last, lists(np.repeat(sketch, len(own), axis=0))],
                                                 ["node", "size", "shingle", "at", "low", "recent", "sketch"])

    return arrow_map(bag.select("node", "bag"), step, "node long, size long, shingle long, at long, low boolean, recent array<long>, sketch array<long>")


def exact_candidates(bag: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """All pairs of nodes of `bag` in different classes that can be so similar by their prefixes and sketches.

    Two bags that are similar enough have a first common shingle after which both still hold enough for their overlap,
    so no pair is lost. The rows of a shingle's largest class meet those of other classes only; the others meet
    all. So no more than about twice the pairs of different classes are looked at. A pair that shares one of the last
    shingles before, too, has met there: both positions left more room, and the smaller bag's was no later.
    """
    rows = prefixes(bag, least).join(labels, "node")
    counts = rows.groupBy("shingle", "label").agg(F.count("*").alias("c"), F.count_if("low").alias("l"))
    hot = (counts.groupBy("shingle").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("n"), F.sum("l").alias("lows"), F.count("*").alias("classes"))
           .where("classes > 1 and lows > 0").select("shingle", "main", (1 + F.floor(F.col("n") / SALT_ROWS)).alias("salts")))
    rows = stored(rows.join(hot, "shingle"))
    one = rows.where("low").select("shingle", F.pmod(F.xxhash64("node"), "salts").alias("salt"), F.col("node").alias("x"), F.col("size").alias("nx"), F.col("at").alias("ix"), F.col("recent").alias("rx"), F.col("sketch").alias("sx"), F.col("label").alias("lx"), (F.col("label") == F.col("main")).alias("mx"))
    two = rows.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("node").alias("y"), F.col("size").alias("ny"), F.col("at").alias("iy"), F.col("recent").alias("ry"), F.col("sketch").alias("sy"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("my"))
    room = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= least / (1 + least) * (F.col("nx") + F.col("ny")) - 1e-6
    fits = (F.col("lx") != F.col("ly")) & (F.col("nx") <= F.col("ny")) & alike("nx", "ny", least) & room & near("nx", "ny", "sx", "sy", least) & ~F.arrays_overlap("rx", "ry")
    met = one.where("not mx").join(two, ["shingle", "salt"]).where(fits).select("x", "y").union(one.where("mx").join(two.where("not my"), ["shingle", "salt"]).where(fits).select("x", "y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every row: rows whose bags are linked by a chain of similarities of at least `least`.

    One row per row of `docs` (doc_id, text), repeated rows included: doc_id, class_id (the least doc_id of its class;
    null if all are null), first (true for one row of each class, its least doc_id's), `__key` (of doc_id and text: `row_key`). Words are lower-cased
    runs of letters, digits and non-ASCII characters; a text of fewer than five words is one shingle. A null text or
    one without words is a class of its own. An empty table gives an empty table. `docs` is read twice;
    rows are numbered in the first reading, and the second finds its texts by their keys, so tasks may be cut otherwise.
    """
    tagged = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__uid"), row_key().alias("__key"))
    own = stored(signed(tagged, shingle, bands, rows), "signatures")
    nodes = stored(own.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("__uid").alias("node"), F.max("size").alias("size")))
    places = own.select("__uid", "bands").join(nodes.select(F.col("node").alias("__uid"), "size"), "__uid").select(F.explode("bands").alias("band"), F.col("__uid").alias("node"), "size")
    centres = places.groupBy("band").agg(F.min(F.struct("node", "size")).alias("c"), F.count("*").alias("n")).where("n > 1").select("band", F.col("c.node").alias("centre"), F.col("c.size").alias("other"))
    places = stored(places.join(centres, "band").join(own.select(F.col("__uid").alias("node"), "sketch"), "node"))
    heads = places.where("node = centre").select("band", F.col("sketch").alias("drawn"))
    star = stored(places.join(heads, "band").where((F.col("node") != F.col("centre")) & alike("size", "other", least) & near("size", "other", "sketch", "drawn", least))
                  .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())

    wanted = places.select(F.col("node").alias("__uid")).distinct()
    keys = own.join(wanted, "__uid").select("__uid", "__key")
    texts_of = docs.select("text", row_key().alias("__key")).join(keys, "__key")
    # rows that repeat both doc_id and text share a key: then each text comes once for every such row
    repeated = not own.groupBy("__key").agg(F.count("*").alias("c")).where("c > 1").join(keys, "__key").isEmpty()
    bag = stored(bag_table(texts_of.dropDuplicates(["__uid"]) if repeated else texts_of, shingle))
    labels = wanted.select(F.col("__uid").alias("node"), F.col("__uid").alias("label"))
    # one centre for each node first: it settles most classes
    labels = merged(labels, verified(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), bag, least))
    labels = merged(labels, verified(by_class(star, labels).select("a", "b"), bag, least))
    places = unsettled(places, labels)
    for turn in range(1, ROUNDS + 1):
        links = verified(other_centres(places, turn, CENTRES, least).join(star, ["a", "b"], "left_anti"), bag, least)
        labels = merged(labels, links)
        if turn == ROUNDS or links.count() < WORTH * places.count():
            break
        places = unsettled(places, labels)
    # what is left goes through the exact join: one pair of each node first, then all that are still in different classes
    rest = unsettled(places, labels).select("node").distinct()
    pairs = stored(exact_candidates(bag.join(rest, "node"), labels, least))
    labels = merged(labels, verified(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), bag, least))
    labels = merged(labels, verified(by_class(pairs, labels).select("a", "b"), bag, least))

    classes = nodes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("class"))
    keyed = own.select("doc_id", "__uid", "__key", "digest").join(classes, "digest", "left").select("doc_id", "__uid", "__key", F.coalesce("class", "__uid").alias("class"))
    heads = keyed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.isnull("doc_id").alias("n"), F.col("doc_id").alias("d"), F.col("__uid").alias("u")))["u"].alias("head"))
    return keyed.join(heads, "class").select("doc_id", "class_id", (F.col("__uid") == F.col("head")).alias("first"), "__key")


@llm_query
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id")
