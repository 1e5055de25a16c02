"""Language-model scores of whole texts by a weighted backoff automaton over words.

**Model.** Every training word has a unigram arc with an absolutely discounted
probability; the discounted mass goes to all other words alike. Every training word is a state, and so is the start
of a text. A state has arcs for all words and the end that follow it in training, with
discounted bigram probabilities, and a failure arc to the unigram state whose weight
makes the state's probabilities sum to one. A text is read once from left to right:
the state is the last word, each word takes its arc or fails first.

**Counting and look-up at scale.** Vocabulary and bigrams grow with the corpus, so they are
never sent to anyone whole. Each task numbers the words it meets in blocks of
about `BLOCK_TOKENS` tokens and writes the texts as numbers, and the block's words dealt to buckets by hash.
A bucket gives its words ids and sums their counts; these return to the blocks. A block then asks, part by part,
for its bigrams (two ids of 32 bits) and its states; a part adds up the bigrams of all blocks and answers with their counts and
the states' sums. The bigrams of a state are in one part, those of a frequent word in several, whose sums are added.
All that moves are packed arrays of numbers, one row per block and bucket or part.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, mix, remainder, scratch_path, table, texts

#: The start and the end of a text as words: white space, which no word is.
START, END = b" ", b"\n"
BLOCK_TOKENS, PART_BYTES, HOT_TOKENS = 3_000_000, 1 << 24, 200_000


def tokens(text: bytes) -> list[bytes]:
    """ASCII letters lowered, cut at ASCII white space, then the end."""
    return [*text.lower().split(), END]


def hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), "u8", len(words)).astype("i8")


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of equal bytes, as many as the largest needs; shuffles and files compress these well."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view("u1").reshape(-1, 8).T[:width].tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, "u1", offset=1).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :b[0]] = planes.T
    return out.view("<u8").ravel().astype("i8")


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b))


def by_number(which: np.ndarray, n: int) -> list[np.ndarray]:
    """The positions of each number below n."""
    which = which.astype("i8")
    order = np.argsort(which, kind="stable")
    return np.split(order, np.searchsorted(which[order], np.arange(1, n)))


def encoded(docs: DataFrame, parts: int) -> DataFrame:
    """Texts as numbers and word lists, in blocks that one task fills.

    Rows with ids: a text. Rows with words: those of the block's list that lie in one bucket, their numbers and how
    often each occurs in training texts. The start of a text is the last of the list, and occurs once a training text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {"block": pa.int64(), "doc_id": None, "held_out": pa.bool_(), "ids": pa.binary(), "bucket": pa.int64(), "words": pa.binary(), "n": pa.binary(), "c": pa.binary()}

    def step(batches):
        block, total, id_type = TaskContext.get().partitionId() << 24, 0, None
        numbers, trained, begun = defaultdict(count().__next__), [], 0

        def batch(size, **columns):
            columns = {"block": pa.array([block] * size, pa.int64()), **columns}
            return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(size, t or id_type) for x, t in types.items()], list(types))

        def lists():
            own = [*numbers, START]
            c = np.bincount(np.concatenate([np.zeros(0, "i8"), *trained]), minlength=len(own))
            c[-1] = begun
            for k, at in enumerate(by_number(hashes(own).view("u8") % np.uint64(parts), parts)):
                if len(at):
                    yield batch(1, bucket=pa.array([k], pa.int64()), words=pa.array([b"\t".join([own[i] for i in at])], pa.binary()),
                                n=pa.array([pack_sorted(at)], pa.binary()), c=pa.array([pack(c[at])], pa.binary()))

        for b in batches:
            id_type = b.column("doc_id").type
            out = []
            for text, held in zip(texts(b), b.column("held_out").to_pylist()):
                ids = np.fromiter(map(numbers.__getitem__, tokens(text)), "u4")
                out.append(pack(ids))
                total += len(ids)
                if not held:
                    trained.append(ids)
                    begun += 1
            yield batch(len(out), doc_id=b.column("doc_id"), held_out=b.column("held_out"), ids=pa.array(out, pa.binary()))
            if total > BLOCK_TOKENS:
                yield from lists()
                numbers, trained, begun, block, total = defaultdict(count().__next__), [], 0, block + 1, 0
        if numbers:
            yield from lists()

    return arrow_map(docs.select("doc_id", "text", "held_out"), step,
                     f"block long, doc_id {kind}, held_out boolean, ids binary, bucket long, words binary, n binary, c binary")


WORDS = "block long, n binary, id binary, c binary, tokens long, types long, once long, twice long"


def numbered(t: pa.Table, parts: int) -> pa.Table:
    """Ids and training counts of one bucket's words, for each block's list; a row without a block has the bucket's sums."""
    lists = [x.split(b"\t") for x in t["words"].to_pylist()]
    rank = {w: i for i, w in enumerate(sorted({w for own in lists for w in own}))}
    at = [np.fromiter(map(rank.__getitem__, own), "i8", len(own)) for own in lists]
    c = np.bincount(np.concatenate(at), np.concatenate([unpack(x) for x in t["c"].to_pylist()]), len(rank)).astype("i8")
    bucket = t["bucket"][0].as_py()
    if len(rank) * parts >= 1 << 32:
        raise ValueError("more words than ids of 32 bits")
    own = np.delete(c, rank[START]) if START in rank else c
    sums = [int(own.sum()), int((own > 0).sum()), int((own == 1).sum()), int((own == 2).sum())]
    return pa.table({
        "block": pa.array([*t["block"].to_pylist(), None], pa.int64()), "n": pa.array([*t["n"].to_pylist(), None], pa.binary()),
        "id": pa.array([*[pack(x * parts + bucket) for x in at], None], pa.binary()), "c": pa.array([*[pack(c[x]) for x in at], None], pa.binary()),
        **{name: pa.array([None] * len(at) + [x], pa.int64()) for name, x in zip(("tokens", "types", "once", "twice"), sums)}})


class Block:
    """A block's texts (`ids` in a row, `first` of each), its words' ids and counts, and its bigrams and states by part."""

    def __init__(self, texts_: pa.Table, words: pa.Table, parts: int):
        own = [unpack(x) for x in texts_["ids"].to_pylist()]
        self.lengths = np.array([len(x) for x in own], "i8")
        self.ids, self.first = np.concatenate(own), np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        at = [unpack_sorted(x) for x in words["n"].to_pylist()]
        size = sum(len(x) for x in at)
        id_, self.c = np.zeros(size, "i8"), np.zeros(size, "i8")
        for x, i, c in zip(at, words["id"].to_pylist(), words["c"].to_pylist()):
            id_[x], self.c[x] = unpack(i), unpack(c)
        self.starts = np.zeros(len(self.ids), bool)
        self.starts[self.first] = True
        before = np.concatenate([[0], self.ids[:-1]])
        before[self.first] = size - 1
        self.known = (self.c[before] > 0) & (self.c[self.ids] > 0)
        left, right = before[self.known], self.ids[self.known]
        self.codes, at, self.which = np.unique(id_[left] << 32 | id_[right], return_index=True, return_inverse=True)
        self.left, self.right = left[at], right[at]
        hashed = mix(id_.view("u8"))
        spread = np.minimum(1 + self.c // HOT_TOKENS, parts).astype("u8")
        self.part = (hashed[self.left] + mix(hashed[self.right]) % spread[self.left]) % np.uint64(parts)
        # a frequent word's sums come from each part that has bigrams of it
        state = np.flatnonzero(self.c > 0)
        state = state[np.argsort(id_[state])]
        self.state = np.repeat(state, spread[state].astype("i8"))
        nth = np.arange(len(self.state)) - np.repeat(np.cumsum(spread[state]) - spread[state], spread[state].astype("i8")).astype("i8")
        self.state_id, self.state_part = id_[self.state], (hashed[self.state] + nth.astype("u8")) % np.uint64(parts)


ASKED = "part long, block long, pairs binary, counts binary, c2 binary, states binary"
ANSWERS = "block long, part long, counts binary, followers binary, c2 binary, once long, twice long"


def asked(texts_: pa.Table, words: pa.Table, parts: int) -> pa.Table:
    """A row per part that has bigrams or states of this block. `c2` are the counts of the bigrams' different second words."""
    b = Block(texts_, words, parts)
    trained = np.repeat(~texts_["held_out"].to_numpy().astype(bool), b.lengths)[b.known]
    counts = np.bincount(b.which, trained, len(b.codes)).astype("i8")
    rows = []
    for k, (at, states) in enumerate(zip(by_number(b.part, parts), by_number(b.state_part, parts))):
        if len(at) or len(states):
            one = np.unique(b.codes[at] & 0xFFFFFFFF, return_index=True)[1]
            rows.append((k, texts_["block"][0].as_py(), pack_sorted(b.codes[at]), pack(counts[at]), pack(b.c[b.right[at]][one]), pack_sorted(b.state_id[states])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64()] * 2 + [pa.binary()] * 4)], [x.split()[0] for x in ASKED.split(", ")])


def answered(t: pa.Table) -> pa.Table:
    """Counts of each block's bigrams, and how many different words follow its states, with the sum of their counts."""
    pairs = [unpack_sorted(x) for x in t["pairs"].to_pylist()]
    codes, which = np.unique(np.concatenate(pairs), return_inverse=True)
    counts = np.bincount(which, np.concatenate([unpack(x) for x in t["counts"].to_pylist()]), len(codes)).astype("i8")
    c2, at = np.zeros(len(codes), "i8"), np.cumsum([0, *map(len, pairs)])
    for own, c, start in zip(pairs, t["c2"].to_pylist(), at):
        if len(own):
            c2[which[start:start + len(own)]] = unpack(c)[np.unique(own & 0xFFFFFFFF, return_inverse=True)[1]]
    met = counts > 0
    states, state = np.unique(codes[met] >> 32, return_inverse=True)
    followers, below = (np.append(np.bincount(state, x, len(states)).astype("i8"), 0) for x in (np.ones(len(state)), c2[met]))
    rows = []
    for block, own, start, ids in zip(t["block"].to_pylist(), pairs, at, t["states"].to_pylist()):
        ids = unpack_sorted(ids)
        place = np.searchsorted(states, ids)
        place = np.where(np.append(states, -1)[place] == ids, place, len(states))
        rows.append((block, pack(counts[which[start:start + len(own)]]), pack(followers[place]), pack(below[place])))
    rows.append((None, None, None, None))
    n = len(rows)
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int64()), "part": pa.array([t["part"][0].as_py()] * n, pa.int64()),
        **{name: pa.array([r[i] for r in rows], pa.binary()) for i, name in ((1, "counts"), (2, "followers"), (3, "c2"))},
        **{name: pa.array([None] * (n - 1) + [int((counts == k).sum())], pa.int64()) for k, name in ((1, "once"), (2, "twice"))}})


class Automaton:
    """Arcs of the states, sorted by pair, failure weights, and the unigram arcs' constants.

    `less` (the arcs' discount) and `fail` are given where the arcs are only a part of the states'.
    """

    def __init__(self, n: int, types: int, once: int, twice: int, state_counts: np.ndarray, starts: int, pairs: np.ndarray, counts: np.ndarray,
                 less: float | None = None, fail: np.ndarray | None = None):
        self.n, self.types, self.states = n, types, len(state_counts)
        self.discount = once / (once + 2 * twice) if once else 0.5
        self.rest = self.discount * types / max(n, 1) / (types + 1)
        self.state_counts = state_counts.astype("f8")
        width = self.states + 1
        order = np.argsort(pairs)
        self.pairs, counts = pairs[order], counts[order].astype("f8")
        first, second = self.pairs // width, self.pairs % width
        history = np.append(self.state_counts, starts)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        if less is None:
            less = ones / (ones + 2 * twos) if ones else 0.5
        p = (counts - less) / history[first]
        self.arcs = np.log10(np.maximum(p, 1e-300))
        if fail is not None:
            self.fail = fail
            return
        taken = np.bincount(first, p, width)
        below = np.bincount(first, self.unigram(self.state_counts)[second], width) if len(first) else np.zeros(width)
        self.fail = np.log10(np.maximum((1 - taken) / np.maximum(1 - below, 1e-12), 1e-300))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(c), 1.0)
        return np.maximum(c - self.discount, 0) / self.n + self.rest

    def score(self, ids: np.ndarray, starts: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 probability of each token; `starts` marks the first tokens of texts, c holds counts by number."""
        width = self.states + 1
        state = np.concatenate([[0], ids[:-1]]).astype("i8")
        state[starts] = width - 1
        in_state = (state < width - 1) | starts
        out = np.log10(self.unigram(c))[ids]
        out[in_state] += self.fail[state[in_state]]
        if len(self.pairs):
            codes = np.where(in_state & (ids < width - 1), state * width + ids, -1)
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            hit = self.pairs[at] == codes
            out[hit] = self.arcs[at[hit]]
        return out


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows of `docs` (doc_id, text, held_out) that are not held out, and score all rows.

    One row per row, repeated rows included: doc_id, held_out, n_tokens (words and the
    end), n_known (tokens seen in training), train_tokens, base_score (add-one unigrams)
    and score, both log10 probabilities of the text. A null or empty text is the end
    alone. A null held_out counts as training. Without training rows all counts are
    zero, every token has base probability 1 and score 0. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, -(-text_bytes // PART_BYTES))
    blocks_at, words_at, answers_at = (scratch_path(spark, f"lm-{x}") for x in ("blocks", "words", "answers"))

    def written(df: DataFrame, at: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    blocks = written(encoded(docs, parts), blocks_at)
    own = blocks.where("ids is not null").select("block", "doc_id", "held_out", "ids")
    lists = blocks.where("words is not null").select("bucket", "block", "words", "n", "c")
    words = written(lists.groupBy("bucket").applyInArrow(lambda t: numbered(t, parts), WORDS), words_at)
    n, types, once, twice = (int(x or 0) for x in words.agg(*[F.sum(x) for x in ("tokens", "types", "once", "twice")]).first())
    known = words.where("block is not null").select("block", "n", "id", "c")
    asks = own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda left, right: asked(left, right, parts), ASKED)
    answers = written(asks.groupBy("part").applyInArrow(answered, ANSWERS), answers_at)
    ones, twos = (int(x or 0) for x in answers.agg(F.sum("once"), F.sum("twice")).first())
    less = ones / (ones + 2 * twos) if ones else 0.5
    both = known.withColumn("part", F.lit(None).cast("long")).withColumn("followers", F.lit(None).cast("binary")).withColumn("below", F.lit(None).cast("binary"))
    both = both.unionByName(answers.where("block is not null").select("block", "part", F.col("counts").alias("c"), "followers", F.col("c2").alias("below")), allowMissingColumns=True)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        of_words = right["part"].is_null()
        b = Block(left, right.filter(of_words), parts)
        counts, followers, below = np.zeros(len(b.codes)), np.zeros(len(b.c)), np.zeros(len(b.c))
        pairs, states = by_number(b.part, parts), by_number(b.state_part, parts)
        for r in right.filter(right["part"].is_valid()).select(["part", "c", "followers", "below"]).to_pylist():
            counts[pairs[r["part"]]] = unpack(r["c"])
            of = b.state[states[r["part"]]]  # a part has a state once
            followers[of] += unpack(r["followers"])
            below[of] += unpack(r["below"])
        m = Automaton(n, types, once, twice, np.zeros(0), 0, np.zeros(0, "i8"), np.zeros(0), less)
        unseen = np.maximum(1 - (below - followers * m.discount) / max(n, 1) - followers * m.rest, 1e-12)
        fail = np.where(b.c > 0, np.log10(np.maximum(less * followers / np.maximum(b.c, 1) / unseen, 1e-300)), 0.0)
        met, width = counts > 0, len(b.c)
        m = Automaton(n, types, once, twice, b.c[:-1], int(b.c[-1]), (b.left * width + b.right)[met], counts[met], less, fail)
        c = b.c[:-1].astype("f8")
        base = np.log10((c + 1) / (n + types + 1))[b.ids]
        return pa.table({
            "doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": b.lengths, "n_known": np.add.reduceat((c > 0)[b.ids].astype("i8"), b.first),
            "train_tokens": np.full(len(left), n, "i8"), "base_score": np.add.reduceat(base, b.first), "score": np.add.reduceat(m.score(b.ids, b.starts, c), b.first)})

    return own.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@llm_query
def op7_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document, from those whose remainder is not 2."""
    docs = table(spark, sf, "documents")
    return lm_scores(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out")))
