"""Collocations: phrases of two to four words that stand together more often than their parts make one expect.

**Counting** sorts suffixes. Each word of a text is the start of a suffix of up to four words within its piece;
a multikey three-way quicksort parts a group of suffixes by their first words into less, equal and greater, then
the equal ones by their second words, and so on to the fourth. The weight of an equal part is the count of the
phrase it stands for; a part below the least count is abandoned, whatever it holds.

**Routing.** All suffixes with the same two leading words meet in one bucket. A first pass counts words, and
pairs of words by the bucket of a hash in a table of fixed size. A pair whose entry stays below the least count
can be in no phrase, so suffixes end before it; most suffixes go no further. A pair whose entry is above
`HOT_WINDOWS` is not gathered: each phrase that begins with it goes to a bucket of its own, added up in every
task before. So no bucket grows with a hot word or a hot passage.

**Words** travel as 64-bit hashes of language and word. The counted words tell whether two of them share a hash
that a phrase could hold; then both passes are done again with another seed. Hashes turn into words at the end,
for the phrases that are returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, mix, stored, table, texts

LEAST, TOP, SHARE = 30, 2000, (4, 5)
#: Entries of the table of pair counts, and the parts in which it is added up.
ENTRIES, PARTS = 1 << 24, 64
#: Words that a task sorts at once: their pairs have to be fewer than 2 ** 21.
FLUSH_WORDS = 1_500_000
#: Suffixes of a bucket about, and those of one pair that are still gathered in one.
BUCKET_WINDOWS, HOT_WINDOWS = 1_000_000, 500_000
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20

_END = b"."
#: ASCII capitals to small letters, and every character that ends a piece to one of them.
_BYTES = bytes(_END[0] if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_GAP = re.compile(rb"[ \t]")
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers of the words of one language, given out as words are met; 0 ends a piece."""

    def __init__(self, lang: str, names: list):
        super().__init__({_END: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names) - 1
        return self[word]


def chunks(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Parts of a text, cut before a space or tab, and whether it is the last."""
    at = 0
    while cut := _GAP.search(text, at + CHUNK):
        yield text[at:cut.start()], False
        at = cut.start()
    yield text[at:], True


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, list]]:
    """Word numbers of the texts one after the other, 0 at the end of every piece; how many of them to count, since the
    last of a text that goes on stand at the head of the next stream; language and word of each number."""
    names, ids, parts, n = [("", _END)], {}, [], 0
    for b in batches:
        for text, lang in zip(texts(b), b.column("lang").to_pylist()):
            for chunk, last in chunks(text):
                words = chunk.translate(_BYTES).replace(_END, b" . ").split()
                if last:
                    words.append(_END)
                parts.append(np.fromiter(map(ids.setdefault(lang, _Ids(lang, names)).__getitem__, words), "i4", len(words)))
                n += len(words)
                if n >= FLUSH_WORDS:
                    whole = np.concatenate(parts)
                    rest = whole[:0] if last else whole[-3:]
                    yield whole, len(whole) - len(rest), names
                    rest = [names[i][1] for i in rest.tolist()]
                    names, ids, n = [("", _END)], {}, len(rest)
                    own = ids.setdefault(lang, _Ids(lang, names))
                    parts = [np.array([own[w] for w in rest], "i4")]
    if n:
        whole = np.concatenate(parts)
        yield whole, len(whole), names


def hashes(names: list, seed: int) -> np.ndarray:
    seeds = {lang: xxhash.xxh64_intdigest(lang, seed) for lang in {x[0] for x in names}}
    out = np.fromiter((xxhash.xxh64_intdigest(word, seeds[lang]) for lang, word in names), "u8", len(names))
    out[out == 0] = 1
    return out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _ODD + b)


def entry(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(ENTRIES)).astype("i8")


def pairs(ids: np.ndarray, size: int) -> np.ndarray:
    """For each position a number for the pair of words that starts there; -1 where a piece ends in between."""
    a, b = ids[:-1].astype("i8"), ids[1:].astype("i8")
    return np.where((a > 0) & (b > 0), a * size + b, -1)


def counted(docs: DataFrame, seed: int) -> DataFrame:
    """First pass. Rows of kind 0: lang, word, id, count; of kind 1: id, the part of the pair table, with its counts."""
    def step(batches):
        own = np.zeros(ENTRIES, "u4")
        kind = lambda k, n: pa.array(np.full(n, k, "i4"))
        for ids, upto, names in streams(batches):
            h = hashes(names, seed)
            c = np.bincount(ids[:upto], minlength=len(names))
            code, each = np.unique(pairs(ids, len(names))[:upto], return_counts=True)
            code, each = code[code >= 0], each[code >= 0]
            np.add.at(own, entry(pair_keys(h[code // len(names)], h[code % len(names)])), each.astype("u4"))
            n = len(names) - 1
            yield pa.RecordBatch.from_arrays(
                [kind(0, n), pa.array([x[0] for x in names[1:]], pa.string()), pa.array([x[1] for x in names[1:]], pa.binary()).cast(pa.string()),
                 pa.array(h[1:].view("i8")), pa.array(c[1:].astype("i8")), pa.nulls(n, pa.binary())], ["kind", "lang", "word", "id", "n", "counts"])
        at = np.flatnonzero(own)
        for part, x in enumerate(np.split(at, np.searchsorted(at, np.arange(1, PARTS) * (ENTRIES // PARTS)))):
            if len(x):  # steps from one entry that is in use to the next, then the counts
                raw = np.concatenate([np.diff(x - part * (ENTRIES // PARTS), prepend=0).astype("u4"), own[x]]).tobytes()
                yield pa.RecordBatch.from_arrays([kind(1, 1), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([part], pa.int64()), pa.nulls(1, pa.int64()), pa.array([raw], pa.binary())],
                                                 ["kind", "lang", "word", "id", "n", "counts"])

    return arrow_map(docs.select("lang", "text"), step, "kind int, lang string, word string, id long, n long, counts binary")


def pair_table(first: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which entries of the pair table reach the least count, which are hot, and the windows that stay. The table has a
    fixed size, and its parts are added up by tasks."""
    def step(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column("id").to_pylist(), b.column("counts").to_pylist()):
                steps, n = np.frombuffer(raw, "u4").reshape(2, -1)
                sums.setdefault(part, np.zeros(ENTRIES // PARTS, "i8"))[np.cumsum(steps, dtype="i8")] += n
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(x >= least).tobytes()], pa.binary()), pa.array([np.packbits(x > HOT_WINDOWS).tobytes()], pa.binary()), pa.array([int(x[x >= least].sum())], pa.int64())],
                                             ["part", "often", "hot", "n"])

    rows = arrow_map(first.where("kind = 1").select("id", "counts").repartition("id"), step, "part long, often binary, hot binary, n long").collect()
    often, hot = np.zeros((2, PARTS, ENTRIES // PARTS // 8), "u1")
    for r in rows:
        often[r.part], hot[r.part] = np.frombuffer(r.often, "u1"), np.frombuffer(r.hot, "u1")
    return often.reshape(-1), hot.reshape(-1), sum(r.n for r in rows)


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def suffixes(ids: np.ndarray, upto: int, h: np.ndarray, often: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different suffixes as four word numbers (0: none), their counts, and the number of words that they are to be
    counted for: 0 for all, else a hot pair's phrase of just so many."""
    size = len(h)
    code, at = np.unique(pairs(ids, size), return_inverse=True)
    keys = entry(pair_keys(h[np.maximum(code, 0) // size], h[np.maximum(code, 0) % size]))
    good = holds(often, keys) & (code >= 0)
    number = np.where(good, np.cumsum(good), 0)
    p = np.concatenate([number[at], np.zeros(3, "i8")])
    a, b, c = p[:-3][:upto], p[1:-2][:upto], p[2:-1][:upto]
    b = np.where(a > 0, b, 0)
    packed, n = np.unique((a << 42 | b << 21 | np.where(b > 0, c, 0))[a > 0], return_counts=True)
    a, b, c = packed >> 42, packed >> 21 & (1 << 21) - 1, packed & (1 << 21) - 1
    code, is_hot = np.concatenate([[0], code[good]]), np.concatenate([[False], holds(hot, keys[good])])
    rows = [(a, b, c, n, 0, ~is_hot[a])]
    for length, own in ((2, packed >> 42 << 42), (3, packed >> 21 << 21), (4, packed)):
        use = is_hot[a] & ([a, b, c][length - 2] > 0)
        if use.any():
            kinds, back = np.unique(own[use], return_inverse=True)
            rows.append((kinds >> 42, kinds >> 21 & (1 << 21) - 1, kinds & (1 << 21) - 1, np.bincount(back, n[use]).astype("i8"), length, np.ones(len(kinds), bool)))
    words = [np.stack([code[a][u] // size, code[a][u] % size, code[b][u] % size, code[c][u] % size]) for a, b, c, _, _, u in rows]
    return np.concatenate(words, axis=1), np.concatenate([x[3][x[5]] for x in rows]), np.concatenate([np.full(int(x[5].sum()), x[4], "u1") for x in rows])


def routed(docs: DataFrame, seed: int, often: np.ndarray, hot: np.ndarray, buckets: int) -> DataFrame:
    """Second pass. Suffixes by bucket: hashes of the words in it, the four columns of numbers among these, counts, lengths."""
    known = docs.sparkSession.sparkContext.broadcast((often, hot))  # two bits for each entry of the pair table

    def step(batches):
        for ids, upto, names in streams(batches):
            h = hashes(names, seed)
            h[0] = 0
            words, n, only = suffixes(ids, upto, h, *known.value)
            lead = pair_keys(h[words[0]], h[words[1]])
            bucket = (np.where(only == 0, lead, pair_keys(pair_keys(lead, h[words[2]]), h[words[3]])) % np.uint64(buckets)).astype("i8")
            order = np.argsort(bucket, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
            start = 0
            for end in ends.tolist() if len(order) else []:
                own = order[start:end]
                start = end
                used, at = np.unique(words[:, own], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([bucket[own[0]]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (h[used], at.reshape(-1).astype("u4"), n[own].astype("u4"), only[own])]],
                                                 ["bucket", "words", "columns", "counts", "only"])

    return arrow_map(docs.select("lang", "text"), step, "bucket long, words binary, columns binary, counts binary, only binary")


def quicksort(columns: np.ndarray, weight: np.ndarray, least: int, shortest: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(a suffix that begins with it, its words, its count) for each phrase of `shortest` to `longest` words whose
    suffixes weigh `least` or more: multikey three-way quicksort of suffix pointers, to the depth of `longest`."""
    todo = [(np.arange(columns.shape[1]), 0)]
    while todo:
        own, depth = todo.pop()
        if len(own) == 0 or int(weight[own].sum()) < least:
            continue
        key = columns[depth][own]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        same = key == pivot
        if not same.all():
            less = key < pivot
            todo += [(own[less], depth), (own[~less & ~same], depth)]
            own = own[same]
        if pivot == 0:
            continue  # these suffixes have ended
        total = int(weight[own].sum())
        if total >= least:
            if shortest <= depth + 1:
                yield int(own[0]), depth + 1, total
            if depth + 1 < longest:
                todo.append((own, depth + 1))


def tallied(suffix_rows: DataFrame, least: int) -> DataFrame:
    """Phrases of two to four words, as hashes (0: none), that occur `least` times or more: w1 to w4, k, a."""
    def finish(rows):
        columns, weight, only = [], [], []
        for words, at, n, o in rows:
            n = np.frombuffer(n, "u4")
            columns.append(np.frombuffer(words, "u8")[np.frombuffer(at, "u4")].reshape(4, len(n)))
            weight.append(n.astype("i8"))
            only.append(np.frombuffer(o, "u1"))
        columns, weight, only = np.concatenate(columns, axis=1), np.concatenate(weight), np.concatenate(only)
        for length in np.unique(only).tolist():
            use = only == length
            part = columns[:, use]
            found = list(quicksort(part, weight[use], least, length or 2, length or 4))
            if found:
                at, k, a = (np.array(x, "i8") for x in zip(*found))
                w = np.where(np.arange(4)[:, None] < k, part[:, at], np.uint64(0)).view("i8")
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in w], pa.array(k), pa.array(a)], ["w1", "w2", "w3", "w4", "k", "a"])

    def step(batches):
        bucket, rows = None, []
        for b in batches:
            for key, *row in zip(*[b.column(c).to_pylist() for c in ("bucket", "words", "columns", "counts", "only")]):
                if key != bucket and rows:
                    yield from finish(rows)
                    rows = []
                bucket = key
                rows.append(row)
        if rows:
            yield from finish(rows)

    dealt = suffix_rows.repartition("bucket").sortWithinPartitions("bucket")
    return arrow_map(dealt, step, "w1 long, w2 long, w3 long, w4 long, k long, a long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (w1 to w4, k, a), words (lang, word, id, n) that occur `least` times or more, and tokens by language (lang, n)."""
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed = 0
    while True:
        first = stored(counted(own, seed), "words")
        words = stored(first.where("kind = 0").groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
        if words.groupBy("id").agg(F.count("*").alias("c"), F.sum("n").alias("n")).where(f"c > 1 and n >= {least}").isEmpty():
            break
        seed += 1  # two words share a hash that phrases could hold
    often, hot, windows = pair_table(first, least)
    rows = routed(own, seed, often, hot, 1 + windows // BUCKET_WINDOWS)
    phrases = stored(tallied(rows, least), "phrases")
    return phrases, words.where(F.col("n") >= least), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _w(first: int, last: int) -> list:
    """Words first to last (from 1) of a phrase, as four columns."""
    return [F.col(f"w{first + i}") if first + i <= last else F.lit(0).cast("long") for i in range(4)]


def _key(first: int, last: int):
    return F.struct(*[c.alias(f"w{i + 1}") for i, c in enumerate(_w(first, last))])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: tuple[int, int] = SHARE) -> DataFrame:
    """The best collocations of each language.

    `docs` has text and lang. Texts are cut into pieces at . , ; : ! ? and line ends, ASCII capitals count as small
    letters, words lie between spaces and tabs. A phrase of two to four words that occurs `least` times or more
    within pieces gets the least of its cuts' scores, floor(2000000 * a / (l + r)); l and r are the counts of the
    parts before and after the cut. It is left out if a longer phrase of that kind holds it and has `share` of its
    count or more.

    One row per language and rank, up to `top`, by score and count descending, then phrase: lang, rank, phrase, a, l,
    r, n (tokens of the language), score. A null text has no words; a null lang is "und". Repeated rows count as
    often as they stand there. A table without such phrases gives an empty table.
    """
    phrases, words, tokens = phrase_counts(docs, least)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    k = ["w1", "w2", "w3", "w4"]
    inner = [F.when(F.col("k") == n, F.array(*[_key(i, i + m - 1) for m in range(2, n) for i in range(1, n - m + 2)])) for n in (3, 4)]
    longer = phrases.where("k > 2").select(F.explode(F.coalesce(*inner)).alias("p"), "a").groupBy("p").agg(F.max("a").alias("longer")).select("p.*", "longer")
    left = (phrases.join(longer, k, "left").where(F.isnull("longer") | (wide("longer") * share[1] < wide("a") * share[0])).drop("longer"))
    parts = phrases.select(*k, "a").union(words.select(F.col("id"), *[F.lit(0).cast("long")] * 3, F.col("n")).toDF(*k, "a"))
    cuts = F.coalesce(*[F.when(F.col("k") == n, F.array(*[F.struct(F.lit(i).alias("cut"), _key(1, i).alias("x"), _key(i + 1, n).alias("y")) for i in range(1, n)])) for n in (2, 3, 4)])
    cut = left.select(*k, "k", "a", F.explode(cuts).alias("c")).select(*k, "k", "a", "c.cut", *[F.col(f"c.{s}.{w}").alias(f"{s}{w}") for s in "xy" for w in k])
    for side, name in (("x", "l"), ("y", "r")):
        cut = cut.join(parts.select(*[F.col(w).alias(f"{side}{w}") for w in k], F.col("a").alias(name)), [f"{side}{w}" for w in k])
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(8,0))) div (cast(l as decimal(20,0)) + r)")
    best = cut.withColumn("score", score).groupBy(*k, "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select(*k, "k", "a", "b.score", "b.l", "b.r")
    known = best.join(words.select(F.col("id").alias("w1"), "lang"), "w1")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    some = stored(known.withColumn("place", F.rank().over(by)).where(F.col("place") <= top), "collocations")
    spelt = (some.select("lang", *k, F.posexplode(F.slice(F.array(*k), 1, F.col("k").cast("int"))).alias("at", "id")).join(words.select("id", "word"), "id")
             .groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    named = some.join(spelt, k).join(tokens, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@llm_query
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best 2000 collocations of each language of the documents."""
    return collocations(table(spark, sf, "documents"))
