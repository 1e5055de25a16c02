"""Best-fit-decreasing packing of tokenised documents into windows.

Tokenising, cutting and checksums happen where the text is read; only short piece
rows are shuffled. A document's full windows are pieces of their own, its rest goes
whole into the tightest open window of its group. Groups are random shares of the
pieces, about `GROUP_PIECES` each, so their number grows with the data and no group
grows. Which piece falls into which group is fixed by a checkpoint before it is
dealt, so a lost executor changes nothing.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, cut, llm_query, table
from augurmill.llm.tokens import Encoder, ranks_path, tokenizer_path

WINDOW, END_ID, GROUP_PIECES = 1024, 0, 32_768


class Tightest:
    """Segment tree over remaining capacities: which is the smallest one open that is large enough?"""

    def __init__(self, window: int):
        self.size = 1 << max(1, window.bit_length())
        self.open = [0] * (2 * self.size)  # windows below each node
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        at = capacity + self.size
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest fit."""
        at = need + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):  # climb to a right sibling with something open
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at + (not self.open[2 * at])
        capacity = at - self.size
        while at:
            self.open[at] -= 1
            at >>= 1
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, longest first; equal lengths in the given order."""
    tree, placed, used = Tightest(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, used = (window, used), used + 1
        capacity, target = found
        placed[i] = (target, window - capacity)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], target)
    return placed


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids, little-endian unsigned 32 bits) of each piece."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batches):
        encoder, end = Encoder.get(tokenizer, ranks), END_ID.to_bytes(4, "little")
        for b in batches:
            row, start, length, crc, total, raw = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = np.array(encoder.ids(text or ""), "<u4").tobytes() + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s:4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    raw.append(piece if with_ids else None)
            columns = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return arrow_map(docs.select("doc_id", "text"), step, schema)


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `window` ids.

    Each document is its ids, then the end id; a null or empty text is the end id
    alone. One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with `with_ids` also the ids. Repeated rows are packed once
    each. Null doc_ids stay null. Other columns of `docs` are not read. An empty
    table gives an empty table. sequence_id is unique, not gapless: the group, then
    the window within it.
    """
    own = cut(pieces(docs, tokenizer, ranks, window, with_ids))
    groups = max(1, math.ceil(own.count() / GROUP_PIECES))
    dealt = own.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit_decreasing(rows["length"].tolist(), window)
        rows["sequence_id"] = rows["__group"].astype("int64") * 2**32 + [w for w, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows.drop(columns="__group")

    schema = own.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("__group").applyInPandas(place, schema)


@llm_query
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, packed into windows of 1024 ids."""
    return pack(table(spark, sf, "documents"), tokenizer_path(), ranks_path())
