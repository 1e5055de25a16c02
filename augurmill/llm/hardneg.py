"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT) over all vectors.

**Tree.** Split points are chosen from a bounded sample, far from each other; a vector belongs to the nearest of
a node's split points, and so on down to a leaf. All rows are dealt to leaves, and on the way every split point
gets the least and greatest distance to the rows below each of its siblings; these ranges, and the norms below
each child, are minima and maxima over tasks.

**Search.** A query asks for the best `k` rows whose inner product with it lies in a window. Inner products,
norms and distances tell each other: d^2 = |q|^2 + |x|^2 - 2 q.x, so a window is an annulus around the query
for rows of known norms. A sibling goes, with all below it, if for one split point the distances that its range
allows miss the annulus. Two leaves near the window's upper end are searched first; where they give `k` rows, the
last of them narrows the window for the other leaves. Leaves are searched exactly, row by row, so nothing is lost.

**Spread.** Rows of a leaf are dealt to blocks of bounded size and the queries that visit it to chunks; a task
holds one block and a few queries, however many meet there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, stored, table

#: Rows the split points are chosen from; children of a node; rows of a leaf, about; rows of a block at most, about.
SAMPLE, FAN, LEAF_ROWS, BLOCK_ROWS = 20_000, 16, 1000, 4000
#: Leaves searched before the others; queries of one chunk; queries that meet a block at once.
SEEDS, CHUNK_QUERIES, AT_ONCE = 2, 20_000, 256
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass
class Tree:
    """Nodes with their split points; a child is a node's number, or ~leaf. Ranges are filled in by `measure`."""

    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf_points: list[np.ndarray] = field(default_factory=list)
    near: list[np.ndarray] = field(default_factory=list)
    far: list[np.ndarray] = field(default_factory=list)
    norms: list[np.ndarray] = field(default_factory=list)


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points."""
    return np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T), 0)


def spread_out(x: np.ndarray, fan: int) -> np.ndarray:
    """Up to `fan` different rows among the first ones, each the farthest from those before it."""
    some = np.unique(x[:16 * fan], axis=0)
    chosen = [0]
    gap = squared(some, some[:1])[:, 0]
    while len(chosen) < min(fan, len(some)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def grow(sample: np.ndarray, rows: int, fan: int = FAN, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over a sample of a table of so many rows, whose leaves hold about `leaf_rows` of them."""
    tree, cell = Tree(), max(2, len(sample) * leaf_rows // max(rows, 1))

    def leaf(point: np.ndarray) -> int:
        tree.leaf_points.append(point)
        return ~(len(tree.leaf_points) - 1)

    def node(x: np.ndarray) -> int:
        at, points = len(tree.points), spread_out(x, max(2, min(fan, -(-len(x) // cell))))
        tree.points.append(points)
        tree.children.append([])
        nearest = squared(x, points).argmin(1)
        for j, point in enumerate(points):
            own = x[nearest == j]
            splits = len(own) > cell and (own != own[0]).any() and len(own) < len(x)
            tree.children[at].append(node(own) if splits else leaf(point))
        return at

    if len(sample) > cell and (sample != sample[0]).any():
        node(sample)
    else:
        leaf(np.zeros(sample.shape[1]))
    return tree


def place(tree: Tree, x: np.ndarray, seen: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Leaf of each row. `seen` keeps, by node, least and greatest squared distances of split points (rows) to the rows
    below children (columns), and squared norms."""
    leaf = np.zeros(len(x), "i4")
    todo = [(0, np.arange(len(x)))] if tree.points else []
    while todo:
        at, own = todo.pop()
        d = squared(x[own], tree.points[at])
        nearest, norm, k = d.argmin(1), (x[own] * x[own]).sum(1), len(tree.points[at])
        low, high, norms = seen.setdefault(at, [np.full((k, k), np.inf), np.full((k, k), -np.inf), np.array([[np.inf], [-np.inf]]).repeat(k, 1)])
        for j in range(k):
            below = nearest == j
            if below.any():
                low[:, j], high[:, j] = np.minimum(low[:, j], d[below].min(0)), np.maximum(high[:, j], d[below].max(0))
                norms[0, j], norms[1, j] = min(norms[0, j], norm[below].min()), max(norms[1, j], norm[below].max())
                child = tree.children[at][j]
                if child < 0:
                    leaf[own[below]] = ~child
                else:
                    todo.append((child, own[below]))
    return leaf


def meets(tree: Tree, q: np.ndarray, low: np.ndarray, high: np.ndarray, leaves: int) -> np.ndarray:
    """Which leaves can hold rows whose inner product with each query lies in its window (infinite where it is open)."""
    out = np.zeros((len(q), leaves), bool)
    norm = (q * q).sum(1)
    todo = [(0, np.arange(len(q)))] if tree.points else []
    if not tree.points:
        out[:] = True
    while todo:
        at, own = todo.pop()
        d = np.sqrt(squared(q[own], tree.points[at]))
        least, most = tree.norms[at]
        # distances are rounded, so all bounds give a little
        give = 1e-6 * (1 + np.sqrt(norm[own])[:, None] + np.sqrt(np.maximum(most, 0)))
        outer = norm[own][:, None] + most - 2 * low[own][:, None]
        inner = norm[own][:, None] + least - 2 * high[own][:, None]
        reach = np.sqrt(np.maximum(outer, 0)) + give
        hole = np.sqrt(np.maximum(inner, 0)) - give
        closest = np.maximum(d[:, :, None] - tree.far[at], tree.near[at] - d[:, :, None])
        open_ = (outer >= -give) & (closest <= reach[:, None, :]).all(1) & (d[:, :, None] + tree.far[at] >= hole[:, None, :]).all(1) & np.isfinite(least)
        for j, child in enumerate(tree.children[at]):
            on = own[open_[:, j]]
            if len(on) and child < 0:
                out[on, ~child] = True
            elif len(on):
                todo.append((child, on))
    return out


class Index:
    """Rows (id, label, vec) of a table, dealt to the leaves of a tree."""

    def __init__(self, rows: DataFrame, fan: int = FAN, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE):
        spark = rows.sparkSession
        self.rows = stored(packed(rows), "vectors")
        top = self.rows.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("most").alias("most")).first()
        self.n, self.size = top["n"], max(top["size"] or 0, 1)
        #: whether inner products are whole numbers that a double holds
        self.exact = self.size * (top["most"] or 0.0) ** 2 < 2.0**52
        share = min(1.0, sample / max(self.n, 1))
        drawn = self.rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).dropDuplicates(["id"]).limit(2 * sample)
        tree = grow(self.matrix([r.vec for r in drawn.orderBy(F.xxhash64("id")).select("vec").collect()]).astype("f8"), self.n, fan, leaf_rows)
        self.leaves = len(tree.leaf_points)
        both = stored(self._placed(tree), "leaves")
        self.placed = both.where("kind = 0").select("leaf", "id", "label", "vec")
        self._measure(tree, both.where("kind = 1"))
        self.tree = tree
        sizes = self.placed.groupBy("leaf").agg(F.count("*").alias("c")).collect()  # no more than leaves, which the sample bounds
        self.blocks = spark.createDataFrame([(r.leaf, 1 + r.c // BLOCK_ROWS) for r in sizes], "leaf int, blocks long")

    def matrix(self, raw: list[bytes]) -> np.ndarray:
        """Vectors as rows; a shorter one ends in zeros. Whole numbers of any size where doubles can't hold the products."""
        return dense(raw, self.size, self.exact)

    def _placed(self, tree: Tree) -> DataFrame:
        size = self.size

        def step(batches):
            seen: dict[int, list[np.ndarray]] = {}
            for b in batches:
                if b.num_rows:
                    leaf = place(tree, dense(b.column("vec").to_pylist(), size, True), seen)
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(leaf), "i4")), pa.array(leaf), b.column("id"), b.column("label"), b.column("vec")], ["kind", "leaf", "id", "label", "vec"])
            for at, parts in seen.items():
                raw = np.concatenate([p.reshape(-1) for p in parts]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([at], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([raw], pa.binary())], ["kind", "leaf", "id", "label", "vec"])

        return arrow_map(self.rows.select("id", "label", "vec"), step, "kind int, leaf int, id long, label long, vec binary")

    def _measure(self, tree: Tree, parts: DataFrame) -> None:
        """Ranges of all nodes: tasks fold those of one node, and one row for each node comes back."""
        fans = [len(p) for p in tree.points]

        def step(batches):
            all_: dict[int, np.ndarray] = {}
            for b in batches:
                for at, raw in zip(b.column("leaf").to_pylist(), b.column("vec").to_pylist()):
                    k, x = fans[at], np.frombuffer(raw, "f8")
                    ups = np.concatenate([np.zeros(k * k, bool), np.ones(k * k, bool), np.zeros(k, bool), np.ones(k, bool)])
                    y = all_.get(at, x)
                    all_[at] = np.where(ups, np.maximum(x, y), np.minimum(x, y))
            for at, x in all_.items():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["leaf", "vec"])

        found = {r.leaf: np.frombuffer(r.vec, "f8") for r in arrow_map(parts.select("leaf", "vec").repartition("leaf"), step, "leaf int, vec binary").collect()}
        for at, k in enumerate(fans):
            x = found.get(at, np.concatenate([np.full(k * k, np.inf), np.full(k * k, -np.inf), np.full(k, np.inf), np.full(k, -np.inf)]))
            tree.near.append(np.sqrt(np.maximum(x[:k * k], 0)).reshape(k, k))
            tree.far.append(np.where(np.isfinite(x[k * k:2 * k * k]), np.sqrt(np.maximum(x[k * k:2 * k * k], 0)), -np.inf).reshape(k, k))
            tree.norms.append(x[2 * k * k:].reshape(2, k))

    def _planned(self, queries: DataFrame, seeds: bool) -> DataFrame:
        """Queries (anchor, slot, label, vec, low, high) with the leaves that they visit: the first ones, or all others that their windows leave."""
        known = queries.sparkSession.sparkContext.broadcast(self.tree)  # bounded by the sample
        size, leaves = self.size, self.leaves

        def step(batches):
            tree = known.value
            points = np.stack(tree.leaf_points)
            for b in batches:
                if not b.num_rows:
                    continue
                q = dense(b.column("vec").to_pylist(), size, True)
                low, high = (np.array(b.column(c).to_pylist(), "f8") for c in ("low", "high"))
                low, high = np.where(low <= LOWEST, -np.inf, low), np.where(high >= HIGHEST, np.inf, high)
                miss = np.abs(q @ points.T - np.where(np.isfinite(high), high, 2.0**80)[:, None])
                first = np.argsort(miss, 1, kind="stable")[:, :SEEDS]
                some = np.zeros((len(q), leaves), bool)
                np.put_along_axis(some, first, True, 1)
                if not seeds:
                    some = meets(tree, q, low, high, leaves) & ~some
                at, leaf = np.nonzero(some)
                ends = np.append(0, np.cumsum(some.sum(1))).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf.astype("i4")))
                yield pa.RecordBatch.from_arrays([lists, *[b.column(c) for c in ("anchor", "slot", "label", "vec", "low", "high")]], ["leaves", "anchor", "slot", "label", "vec", "low", "high"])

        return stored(arrow_map(queries.select("anchor", "slot", "label", "vec", "low", "high"), step, "leaves array<int>, anchor long, slot int, label long, vec binary, low long, high long"), "visits")

    def _visited(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """Each block's best `k` rows for each query that visits it: anchor, slot, id, score."""
        size, exact = self.size, self.exact
        # one row for each leaf: no more than the sample has rows
        chunks = F.broadcast(visits.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg((1 + F.floor(F.count("*") / CHUNK_QUERIES)).alias("chunks")).join(F.broadcast(self.blocks), "leaf"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        null = lambda kind: F.lit(None).cast(kind)
        rows = (self.placed.join(chunks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("chunk", every("chunks"))
                .select("leaf", "block", "chunk", F.lit(0).alias("kind"), "id", null("int").alias("slot"), "label", "vec", null("long").alias("low"), null("long").alias("high")))
        callers = (visits.withColumn("leaf", F.explode("leaves")).join(chunks, "leaf").withColumn("chunk", F.pmod(F.xxhash64("anchor", "slot"), "chunks")).withColumn("block", every("blocks"))
                   .select("leaf", "block", "chunk", F.lit(1).alias("kind"), F.col("anchor").alias("id"), "slot", "label", "vec", "low", "high"))

        def answers(block, callers):
            ids, labels, x = block
            q = dense([c[3] for c in callers], size, exact)
            scores = q @ x.T
            if not exact and scores.size and not LOWEST < scores.min() <= scores.max() < HIGHEST:
                raise OverflowError("a score needs more than 64 bits")
            for (anchor, slot, label, _, low, high), own in zip(callers, scores):
                use = np.flatnonzero((own >= low) & (own <= high) & (ids != anchor) & ((labels == label) if same else (labels != label)))
                s = own[use]
                if len(s) > k:
                    last = np.partition(s, len(s) - k)[len(s) - k] if exact else sorted(s)[-k]
                    use, s = use[s >= last], s[s >= last]
                order = np.lexsort((ids[use], -s))[:k] if exact else np.array(sorted(range(len(s)), key=lambda i: (-s[i], ids[use[i]]))[:k], "i8")
                for i in order.tolist():
                    yield anchor, slot, int(ids[use[i]]), int(s[i])

        def step(batches):
            key, block, raw, waiting = None, None, [], []

            def out(rows):
                a, slot, i, s = zip(*rows)
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(slot, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["anchor", "slot", "id", "score"])

            def flush():
                found = list(answers(block, waiting)) if waiting else []
                waiting.clear()
                return [out(found)] if found else []

            for b in batches:
                names = ("leaf", "block", "chunk", "kind", "id", "slot", "label", "vec", "low", "high")
                for leaf, part, chunk, kind, i, slot, label, vec, low, high in zip(*[b.column(c).to_pylist() for c in names]):
                    if (leaf, part, chunk) != key:
                        yield from flush()
                        key, block, raw = (leaf, part, chunk), None, []
                    if kind == 0:
                        raw.append((i, label, vec))
                        continue
                    if block is None:
                        ids, labels, vectors = zip(*raw) if raw else ((), (), ())
                        block, raw = (np.array(ids, "i8"), np.array(labels, "i8"), dense(list(vectors), size, exact)), []
                    waiting.append((i, slot, label, vec, low, high))
                    if len(waiting) >= AT_ONCE:
                        yield from flush()
            yield from flush()

        dealt = rows.union(callers).repartition("leaf", "block", "chunk").sortWithinPartitions("leaf", "block", "chunk", "kind")
        return arrow_map(dealt, step, "anchor long, slot int, id long, score long")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """The best `k` rows of each query by (score descending, id): anchor, slot, id, score, rank. Rows are of the query's
        label, or of others, have a score from low to high, and another id than the anchor. Exact."""
        by = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        best = lambda found: found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        first = stored(best(self._visited(self._planned(queries, True), k, same)), "found").drop("rank")
        last = first.groupBy("anchor", "slot").agg(F.count("*").alias("c"), F.min("score").alias("last")).where(F.col("c") >= k)
        narrowed = queries.join(last, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", "last")).select(*queries.columns)
        return best(first.union(self._visited(self._planned(narrowed, False), k, same)))


def dense(raw: list[bytes], size: int, exact: bool) -> np.ndarray:
    out = np.zeros((len(raw), size), "f8")
    for row, x in zip(out, raw):
        own = np.frombuffer(x, "f8")
        row[:len(own)] = own
    return out if exact else np.array([[int(v) for v in row] for row in out], object).reshape(len(raw), size)


def packed(rows: DataFrame) -> DataFrame:
    """id, label, the components floor(256 * x) as doubles in one binary, how many they are and the greatest of them by size."""
    def step(batches):
        for b in batches:
            vectors = [np.floor(256 * np.array(v, "f8")) for v in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([len(v) for v in vectors], pa.int32()),
                                              pa.array([float(np.abs(v).max(initial=0)) for v in vectors], pa.float64())], ["id", "label", "vec", "size", "most"])

    return arrow_map(rows.select("id", "label", "vector"), step, "id long, label long, vec binary, size int, most double")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **tree: int) -> DataFrame:
    """Negatives of each anchor and positive: the best rows of another label that score well, but below the positive.

    `rows` has id and label (whole numbers) and vector (numbers); `anchor` tells which rows are anchors. A component x
    counts as floor(256 * x), a score is the inner product of two rows, higher first, ties by smaller id. Positives of
    an anchor are its first other rows of the same label; negatives those of another label whose score is `low` to
    `high` hundredths of the positive's, both included. One row each: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score. An anchor or positive without such rows gives none.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors end
    in zeros. Repeated rows count as often as they stand there, but no row of the anchor's own id is its positive or
    negative; of several anchors with one id the least by label and vector asks. An empty table gives an empty
    table. Scores have to fit into 64 bits, else the job fails. `tree`: fan, leaf_rows, sample of the index.
    """
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", good))
    index = Index(own, **tree)
    asks = (own.where("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector"))
    asks = stored(packed(asks), "anchors")
    queries = asks.select(F.col("id").alias("anchor"), F.lit(0).alias("slot"), "label", "vec", F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high"))
    found = stored(index.search(queries, positives, True).select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    edge = lambda share, turn: (turn(F.col("positive_score").cast("decimal(24,0)") * share / 100)).cast("long")
    windows = (found.join(asks.select(F.col("id").alias("anchor"), "label", "vec"), "anchor")
               .select("anchor", "slot", "label", "vec", edge(low, F.ceil).alias("low"), edge(high, F.floor).alias("high")).where("low <= high"))
    out = index.search(windows, negatives, False).join(found, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@llm_query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every embedding whose vec_id is divisible by 100, against all; labels are moved on where it is divisible by 7."""
    e = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")), F.col("id") % 100 == 0)
