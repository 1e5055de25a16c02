"""Which documents contain passages of benchmark items: Wu-Manber search over words.

Patterns are the windows of 13 words of all items (an item of fewer words is one
window). For each pattern length a table gives, for a block of two words, how far the
search may jump: the least distance from that block to the end of any pattern, or the
longest jump for blocks that no pattern has. Where it is zero, the bucket of patterns
that end in this block is compared directly.

Documents are scanned where they are read; nothing is shuffled. The items go to the
executors in blocks of bounded size (`BLOCK_CHARS`), one pass over the documents for
each block, with the hits so far carried along and the lineage cut in between.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, cut, llm_query, table, texts, words_of

WINDOW, BLOCK_CHARS = 13, 16_000_000


class WuManber:
    """Patterns of one length, each a list of words, with the items they stand for."""

    def __init__(self, length: int, patterns: dict[tuple, list[int]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self._key(words, end - 1)
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.bucket.setdefault(self._key(words, length - 1), []).append((list(words), items))

    def _key(self, words, at: int):
        return (words[at - 1], words[at]) if self.block == 2 else words[at]

    def search(self, words: list) -> list[tuple[int, list[int]]]:
        """(index of the first word, items) of every occurrence, by position."""
        found, at, length, jump, shift = [], self.length - 1, self.length, self.jump, self.shift.get
        pairs = self.block == 2
        while at < len(words):
            key = (words[at - 1], words[at]) if pairs else words[at]
            step = shift(key, jump)
            if step:
                at += step
                continue
            for pattern, items in self.bucket[key]:
                if words[at - length + 1:at + 1] == pattern:
                    found.append((at - length + 1, items))
            at += 1
        return found


def build(items: list[tuple[object, bytes]], window: int) -> tuple[list[WuManber], list[str | None]]:
    """Searchers by length, and the items' names. Items without words have no window."""
    names = sorted({None if i is None else str(i) for i, _ in items}, key=lambda x: (x is None, x))
    number = {x: k for k, x in enumerate(names)}
    by_length: dict[int, dict[tuple, list[int]]] = {}
    for name, text in items:
        words, own = words_of(text), number[None if name is None else str(name)]
        length = min(window, len(words))
        for s in range(len(words) - length + 1 if words else 0):
            known = by_length.setdefault(length, {}).setdefault(tuple(words[s:s + length]), [])
            if own not in known:
                known.append(own)
    return [WuManber(k, v) for k, v in sorted(by_length.items())], names


def scan(docs: DataFrame, items: list[tuple[object, bytes]], window: int) -> DataFrame:
    """Add to each row's hits (`__spans`: start, end in words; `__items`) those of one block of items."""
    block = docs.sparkSession.sparkContext.broadcast(items)
    made: list = []

    def step(batches):
        if not made:
            made.append(build(block.value, window))
        searchers, names = made[0]
        for b in batches:
            n, spans, found = [], [], []
            before = zip(b.column("__spans").to_pylist(), b.column("__items").to_pylist())
            for text, (old_spans, old_items) in zip(texts(b), before):
                words = words_of(text)
                hits = [(s, x.length, own) for x in searchers for s, own in x.search(words)]
                n.append(len(words))
                spans.append(old_spans + np.array([(s, s + k) for s, k, _ in hits], "<i4").tobytes())
                found.append(sorted({*old_items, *(names[i] for _, _, own in hits for i in own if names[i] is not None)}))
            columns = {"__n": pa.array(n, pa.int64()), "__spans": pa.array(spans, pa.binary()), "__items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns.get(x, b.column(i)) for i, x in enumerate(b.schema.names)], b.schema.names)

    return arrow_map(docs, step, docs.schema)


def covered(raw: bytes) -> int:
    """Words inside any span."""
    spans = np.frombuffer(raw, "<i4").reshape(-1, 2)
    if not len(spans):
        return 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    before = np.concatenate([[0], reach[:-1]])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], before)).sum())


def item_blocks(benchmark: DataFrame):
    """The items in lists of bounded size, by hash; the number of lists follows the benchmark's characters."""
    own = benchmark.select(F.col("item_id").alias("i"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    chars = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else own
        yield [(r["i"], bytes(r["t"])) for r in rows.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Words of each document that lie inside benchmark windows.

    One row per row of `docs` (doc_id, text; `keep` names further columns to carry):
    n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words), and `item_ids`. A null or empty
    text has no words and is never contaminated. An item with a null id marks words
    but is neither counted nor listed; ids that occur twice count once. Without items,
    or with items that have no words, nothing is hit. Empty tables give empty results.
    """
    kept = keep or ["doc_id"]
    state = docs.select("text", *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(kept)], F.lit(0).cast("long").alias("__n"),
                        F.lit(b"").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    for k, items in enumerate(item_blocks(benchmark)):
        state = scan(cut(state) if k else state, items, window)

    def finish(batches):
        for b in batches:
            raw, found = b.column("__spans").to_pylist(), b.column("__items").to_pylist()
            hit = [covered(x) for x in raw]
            total = b.column("__n").to_pylist()
            new = {"n_words": pa.array(total, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in found], pa.int64()),
                   "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                   "contaminated": pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, total)], pa.bool_()), "item_ids": b.column("__items")}
            kept_columns = [b.column(f"__k{i}") for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*kept_columns, *new.values()], [*(f"__k{i}" for i in range(len(kept))), *new])

    types = ", ".join(f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept))
    out = arrow_map(state, finish, types + ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>")
    # the item ids are the operator's, whatever the documents call their columns
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids")


@llm_query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("item_ids")
