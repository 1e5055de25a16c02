"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

**Labelled tokens.** Labels are by document. From a bounded sample of labelled
documents a lexicon of words and word beginnings is induced by their likelihood
ratio; copies of a passage count once. A token is labelled toxic if its document is
and its word or a beginning of it is in the lexicon.

**Field.** Two states; features of a token are its word, its neighbours' words, its
prefixes of four to eight bytes, and the transitions. Training maximises the penalised
likelihood by gradient ascent with forward-backward expectations.

**Scoring.** Texts are tagged where they are read. The forward and backward passes
run over a whole batch at once: the chain is cut into blocks whose transfer matrices
are multiplied first, which gives each block its exact start message, so no pass
loops over tokens. A logistic model on the marginals' maximum and sums gives the
document's score. Only the bounded model is sent to the tasks; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, remainder, table, texts, words_of

#: Bounds of the training sample: clean and toxic labelled documents, and windows of words from them.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW_WORDS = (2_000, 1_000), 40_000, 32
BLOCK = 256
#: Bytes of text that are scored at once; a task's arrays are some hundred times as large.
BATCH_BYTES = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Field:
    """Weights that a token's features add to the toxic state, and the 2 x 2 transitions (log scale)."""

    word: dict[bytes, float]
    left: dict[bytes, float]
    right: dict[bytes, float]
    prefix: dict[bytes, float]
    bias: float
    trans: np.ndarray
    doc: np.ndarray

    def emissions(self, words: list[bytes], starts: np.ndarray) -> np.ndarray:
        """Log weight of the toxic state at each token; `starts` marks first tokens of texts."""
        local: dict[bytes, int] = {}
        ids = np.fromiter((local.setdefault(w, len(local)) for w in words), "i8", len(words))
        table_of = lambda d, cut=None: np.array([d.get(w[:cut], 0.0) if not cut or len(w) >= cut else 0.0 for w in local], "f8")
        e = self.bias + (table_of(self.word) + sum(table_of(self.prefix, k) for k in PREFIXES))[ids]
        ends = np.append(starts[1:], True)
        before, after = table_of(self.left)[ids], table_of(self.right)[ids]
        e[1:] += np.where(starts[1:], 0, before[:-1])
        e[:-1] += np.where(ends[:-1], 0, after[1:])
        return e


def chain(e: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Forward messages of both states at each token, scaled to sum to one, for many texts in one row.

    A text's first token has no transition. Blocks of `BLOCK` tokens are passed with both unit vectors at once to get
    their transfer matrices; those are chained, and each block runs again from its start message.
    """
    n = len(e)
    width = -(-n // BLOCK)
    pad = width * BLOCK - n
    w = np.exp(np.clip(np.concatenate([e, np.zeros(pad)]), -50, 50)).reshape(width, BLOCK)
    first = np.concatenate([starts, np.zeros(pad, bool)]).reshape(width, BLOCK)
    t = np.exp(trans)

    def advance(m: np.ndarray, j: int) -> np.ndarray:
        """m: (blocks, rows, 2) messages before token j of each block."""
        total = m.sum(2)
        a = np.where(first[:, j, None], total, m[:, :, 0] * t[0, 0] + m[:, :, 1] * t[1, 0])
        b = np.where(first[:, j, None], total, m[:, :, 0] * t[0, 1] + m[:, :, 1] * t[1, 1]) * w[:, j, None]
        return np.stack([a, b], 2) / np.maximum((a + b).max(1), 1e-300)[:, None, None]

    m = np.broadcast_to(np.eye(2), (width, 2, 2)).copy()
    for j in range(BLOCK):
        m = advance(m, j)
    start, at = np.empty((width, 1, 2)), np.array([0.5, 0.5])
    for k in range(width):
        start[k, 0] = at
        at = at @ m[k]
        at = at / at.sum()
    out, m = np.empty((width, BLOCK, 2)), start
    for j in range(BLOCK):
        m = advance(m, j)
        m = m / m.sum(2, keepdims=True)
        out[:, j] = m[:, 0]
    return out.reshape(-1, 2)[:n]


def marginals(e: np.ndarray, trans: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token."""
    if not len(e):
        return np.zeros(0)
    forward = chain(e, trans, starts)
    ends = np.append(starts[1:], True)
    back = chain(e[::-1], trans.T, ends[::-1])[::-1]  # includes the token's own weight
    w = np.exp(np.clip(e, -50, 50))
    both = forward * back / np.stack([np.ones_like(w), w], 1)
    return both[:, 1] / both.sum(1)


def entries(word: bytes) -> list[bytes]:
    """What a lexicon may hold of a word: itself, and its beginnings (marked by their length's stars)."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) >= k)]


def induce(windows: list[tuple], least: int = 5, ratio: float = 8.0, evidence: float = 22.0) -> set[bytes]:
    """Entries that tell toxic windows from clean ones.

    An entry's occurrences count once for each word before it, so copies of a passage count once. It is taken if it has
    `least` toxic ones, its rate is `ratio` times that of clean text, and the likelihood ratio statistic is `evidence`.
    """
    counts: tuple[dict, dict] = {}, {}
    total, met = [0, 0], set()
    for _, toxic, words in windows:
        for before, w in zip([b"", *words], words):
            pair = hashlib.blake2b(b"%d %b %b" % (toxic, before, w), digest_size=8).digest()  # the same in every process
            if pair not in met:
                met.add(pair)
                total[toxic] += 1
                for x in entries(w):
                    counts[toxic][x] = counts[toxic].get(x, 0) + 1
    if not total[0] or not total[1]:
        return set()
    q = total[1] / (total[0] + total[1])
    lexicon = set()
    for x, t in counts[1].items():
        c = counts[0].get(x, 0)
        if t < least or t * total[0] < ratio * (c + 0.5) * total[1]:
            continue
        n = t + c
        if 2 * (t * math.log(t / (n * q)) + (c * math.log(c / (n * (1 - q))) if c else 0)) >= evidence:
            lexicon.add(x)
    return lexicon


def features(words: list[bytes], i: int) -> list[bytes | None]:
    """Word, left and right neighbour, beginnings of exactly the given lengths."""
    w = words[i]
    return [w, words[i - 1] if i else None, words[i + 1] if i + 1 < len(words) else None, *(w[:k] if len(w) >= k else None for k in PREFIXES)]


def fit(windows: list[tuple], steps: int = 40, penalty: float = 1e-3) -> Field:
    """windows: (document, toxic, words). One window is one chain."""
    lexicon = induce(windows)
    maps: list[dict[bytes, int]] = [{} for _ in range(3 + len(PREFIXES))]
    seen: dict[bytes, int] = {}
    for _, _, words in windows:
        for w in words:
            seen[w] = seen.get(w, 0) + 1
    usual = {w for w, n in seen.items() if n >= 3}
    columns, starts, labels = [[] for _ in maps], [], []
    # words near lexicon words carry all the evidence; of the other windows every eighth is kept as background
    for k, (_, toxic, words) in enumerate(windows):
        tags = [bool(toxic) and not lexicon.isdisjoint(entries(w)) for w in words]
        if not any(tags) and k % 8:
            continue
        for i, w in enumerate(words):
            for k_, (c, m, f) in enumerate(zip(columns, maps, features(words, i))):
                c.append(-1 if f is None or (k_ < 3 and f not in usual) else m.setdefault(f, len(m)))
            starts.append(i == 0)
            labels.append(tags[i])
    n = len(labels)
    if not n or not lexicon:
        return Field({}, {}, {}, {}, -5.0, np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    y, starts = np.array(labels, bool), np.array(starts)
    columns = [np.array(c) for c in columns]
    use = [c >= 0 for c in columns]
    theta = [np.zeros(len(m)) for m in maps]
    bias, trans = -2.0, np.zeros((2, 2))
    inside = ~starts[1:]
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[:-1][inside].astype(int), y[1:][inside].astype(int)), 1)
    squares = [np.full(len(m), 1e-8) for m in maps], [1e-8], np.full((2, 2), 1e-8)
    for _ in range(steps):
        e = np.full(n, bias)
        for c, u, t in zip(columns, use, theta):
            e[u] += t[c[u]]
        p = marginals(e, trans, starts)
        miss = y - p
        for k in range(len(maps)):
            g = np.bincount(columns[k][use[k]], miss[use[k]], len(theta[k])) - penalty * n / 1000 * theta[k]
            squares[0][k] += g * g
            theta[k] += 0.8 * g / np.sqrt(squares[0][k])
        g = miss.sum()
        squares[1][0] += g * g
        bias += 0.8 * g / np.sqrt(squares[1][0])
        # expected transitions, from pairwise marginals of neighbours
        f = chain(e, trans, starts)
        b = chain(e[::-1], trans.T, np.append(starts[1:], True)[::-1])[::-1]
        joint = f[:-1, :, None] * np.exp(trans)[None] * b[1:, None, :]
        joint = (joint / joint.sum((1, 2), keepdims=True))[inside].sum(0)
        g = seen_pairs - joint - penalty * n / 1000 * trans
        squares[2][:] += g * g
        trans = trans + 0.3 * g / np.sqrt(squares[2])
    weights = [{k: v for k, v in zip(m, t.tolist()) if abs(v) > 0.05} for m, t in zip(maps, theta)]
    field = Field(*weights[:3], {k: v for w in weights[3:] for k, v in w.items()}, bias, trans, np.zeros(3))
    field.doc = fit_documents(field, windows)
    return field


def doc_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Constant, largest marginal, log of their sum, for each text; `first` are the texts' first tokens."""
    return np.stack([np.ones(len(first)), np.maximum.reduceat(p, first), np.log1p(np.add.reduceat(p, first))], 1)


def fit_documents(field: Field, windows: list[tuple], steps: int = 400) -> np.ndarray:
    """Weights of the logistic model of a document, from the sample's windows put together by document."""
    docs: dict[object, tuple[int, list[bytes]]] = {}
    for doc, toxic, words in windows:
        docs.setdefault(doc, (toxic, []))[1].extend(words)
    own = [v for v in docs.values() if v[1]]
    first = np.cumsum([0, *(len(v[1]) for v in own)])[:-1]
    flat = [w for v in own for w in v[1]]
    starts = np.zeros(len(flat), bool)
    starts[first] = True
    x, y = doc_features(marginals(field.emissions(flat, starts), field.trans, starts), first), np.array([v[0] for v in own], "f8")
    w = np.zeros(3)
    for _ in range(steps):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (y - q) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on labelled documents. `labels`: doc_id, toxic; the first of equal ids counts, null labels are left out.

    The sample is bounded: of each class as many labelled ids as `SAMPLE_DOCS` says, those of least hash, and of their windows the
    `SAMPLE_WINDOWS` of least hash.
    """
    spark = docs.sparkSession
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    ids = [r for k in (0, 1) for r in own.where((F.col("toxic") == 1) == (k == 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS[k]).collect()]
    if not ids:
        return fit([])
    sample = spark.createDataFrame([(r["doc_id"], int(r["toxic"] == 1)) for r in ids], f"doc_id {own.schema['doc_id'].dataType.simpleString()}, toxic int")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sum(SAMPLE_DOCS) ids

    def cut(batches):
        for b in batches:
            rows = []
            for doc, toxic, text in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), texts(b)):
                words = words_of(text)
                rows += [(str(doc), toxic, i, b" ".join(words[i:i + WINDOW_WORDS])) for i in range(0, len(words), WINDOW_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                                             ["doc_id", "toxic", "at", "words"])

    windows = arrow_map(chosen.select("doc_id", "toxic", "text"), cut, "doc_id string, toxic int, at long, words binary")
    rows = windows.orderBy(F.xxhash64("doc_id", "at", "words"), "doc_id", "at", "words").limit(SAMPLE_WINDOWS).collect()
    known: dict[bytes, bytes] = {}
    return fit([(r["doc_id"], r["toxic"], [known.setdefault(w, w) for w in bytes(r["words"]).split(b" ")]) for r in rows])


def toxicity(docs: DataFrame, field: Field, keep: list[str] | None = None, threshold: float = 0.7, spans: bool = True) -> DataFrame:
    """Score every text.

    One row per row of `docs` (`keep` columns, doc_id by default, and text): score (0 to 1), predicted (1 if score >=
    threshold), and with `spans` the offending words as start and end among the text's words. A null or empty text has
    no marginals and gets the score of a text without evidence. An empty table gives an empty table.
    """
    kept = keep or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(field)
    name = f"__k{kept.index('text')}" if "text" in kept else "text"

    def step(batches):
        for b in batches:
            split = [words_of(x) for x in texts(b, name)]
            lengths = np.array([len(x) for x in split])
            flat = [w for x in split for w in x]
            full = lengths > 0
            first = (np.cumsum(lengths) - lengths)[full]
            starts = np.zeros(len(flat), bool)
            starts[first] = True
            m: Field = model.value
            p = marginals(m.emissions(flat, starts), m.trans, starts) if flat else np.zeros(0)
            x = np.tile([1.0, 0.0, 0.0], (len(split), 1))
            if flat:
                x[full] = doc_features(p, first)
            score = 1 / (1 + np.exp(-np.clip(x @ m.doc, -30, 30)))
            columns = [b.column(f"__k{i}") for i in range(len(kept))] + [pa.array(score), pa.array((score >= threshold).astype("i4"), pa.int32())]
            if spans:
                found: list[list] = [[] for _ in split]
                row = np.repeat(np.arange(len(split)), lengths)
                base = np.cumsum(lengths) - lengths
                for at in np.flatnonzero(p >= 0.5).tolist():
                    own, place = found[row[at]], int(at - base[row[at]])
                    if own and own[-1]["end"] == place:
                        own[-1]["end"] = place + 1
                    else:
                        own.append({"start": place, "end": place + 1})
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, [*(f"__k{i}" for i in range(len(kept))), "score", "predicted", *["spans"] * spans])

    types = "".join(f"__k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    own = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], *["text"] * (name == "text"))
    out = arrow_map(own, step, types + "score double, predicted int" + ", spans array<struct<start: int, end: int>>" * spans, BATCH_BYTES)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "score", "predicted", *["spans"] * spans)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels one may learn from: those whose id's remainder is not 1."""
    return labels.where(remainder(F.col("doc_id"), 3) != 1).select("doc_id", "toxic")


@llm_query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document."""
    docs = table(spark, sf, "documents")
    field = train(docs, training_labels(table(spark, sf, "labels")))
    out = toxicity(docs, field, spans=False)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
