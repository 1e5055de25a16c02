"""Secrets in texts: candidate strings, judged by a random forest trained on labelled findings.

Candidates are unbroken strings of at least `MIN_LENGTH` key characters. Features:
length, shares of digits, capitals and other signs, improbability of character transitions
(against a table from all words of the texts), entropy, share covered by words that the texts use,
whether the string looks like a path, an address or a word, and whether the words
before it name a secret. Findings without a label of their own are labelled by rules of
high precision (known key formats, assignments to secret names with a random value; ordinary words, addresses and
numbers as false positives).

Words and findings are those of all texts. The dictionary is a table: strings meet it in a join, by their runs of
letters. The forest grows level by level: tasks add up every finding per node, feature and bin of a fixed grid, so
what comes back is bounded by the trees and not by the findings. Verdicts return to the texts by row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Container
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurmill.llm.common import arrow_map, llm_query, stored, table

MIN_LENGTH = 12
CANDIDATE = re.compile(r"[A-Za-z0-9_/+=.@:-]{12,}")
# Formats that issuers publish, and names that precede a secret.
FORMATS = re.compile(r"AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk_live_[0-9A-Za-z]{16,}|eyJ[\w-]+\.[\w-]+\.[\w-]+")
NAMES = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api_?key|access_?key|auth)[\"']?\s*[:=]\s*[\"']?$")
INSIDE = re.compile(r"(?i)^(?:password|passwd|pwd|token|secret|api_?key|access_?key|auth)[:=]+(?=.)")
FEATURES = 11
_SHARES, _SIGN = np.arange(64) / 64, np.array([0.5])
#: Thresholds of each feature that a split may have.
GRID = [np.concatenate([np.arange(MIN_LENGTH, 96), 96 * 2.0 ** np.arange(1, 24)]), _SHARES, _SHARES, _SHARES, np.arange(-69, 0) / 10, np.arange(80) / 10,
        _SHARES, _SIGN, _SIGN, _SIGN, _SIGN]
BINS = max(len(g) for g in GRID) + 1


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text before) of each candidate; a secret's name before a sign is not part of it."""
    found = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in ".,:-/=":
            e -= 1
        inside = INSIDE.match(text[s:e])
        if inside:
            s += inside.end()
        if e - s >= MIN_LENGTH and not (text[s:e].isalpha()):
            found.append((s, e, text[max(0, s - 40):s]))
    return found


def named(before: str) -> bool:
    return bool(NAMES.search(before))


def features(own: str, before: str, pairs: dict[str, float], words: Container[str]) -> list[float]:
    return described(own, named(before), pairs, words)


def described(own: str, is_named: bool, pairs: dict[str, float], words: Container[str]) -> list[float]:
    n = len(own)
    counts = [own.count(c) for c in set(own)]
    runs = re.findall(r"[a-z]{3,}", own.lower())
    steps = [pairs.get(own[i:i + 2].lower(), -7.0) for i in range(n - 1)]
    return [n, sum(c.isdigit() for c in own) / n, sum(c.isupper() for c in own) / n, sum(not c.isalnum() for c in own) / n,
            sum(steps) / max(1, len(steps)), -sum(c / n * math.log2(c / n) for c in counts), sum(len(r) for r in runs if r in words) / n,
            float(own.count("/") >= 2 or "." in own and "/" in own), float("@" in own), float(is_named),
            float(bool(re.fullmatch(r"[0-9.:+-]+", own)))]


def label(own: str, before: str) -> int | None:
    """1: a secret, 0: a false positive, None: unclear."""
    if FORMATS.fullmatch(own) or NAMES.search(before) and any(c.isdigit() for c in own) and len(set(own)) >= 8:
        return 1
    if "@" in own or re.fullmatch(r"[0-9.:+-]+|[A-Za-z]+(?:[-_./'=:][A-Za-z]+)*[-_./=:]?", own):
        return 0
    return None


class Words:
    """The words that texts use: a table (word), and single look-ups in it on the driver."""

    def __init__(self, table: DataFrame):
        self.table, self.met = table, {}

    def __contains__(self, word: str) -> bool:
        if word not in self.met:
            self.met[word] = not self.table.where(F.col("word") == word).isEmpty()
        return self.met[word]


@dataclass
class Forest:
    """Trees as (feature, threshold, left, right, value) rows, and what the features need."""

    trees: list[list[tuple]]
    pairs: dict[str, float]
    words: Words

    def score(self, x: list[float]) -> float:
        total = 0.0
        for t in self.trees:
            k = 0
            while t[k][0] >= 0:
                k = t[k][2] if x[t[k][0]] <= t[k][1] else t[k][3]
            total += t[k][4]
        return total / len(self.trees) if self.trees else 0.0


@dataclass
class Growth:
    """A tree while it grows: per node its feature (-1: a leaf), bin, children and value, and the nodes to be split next."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), "i8")
        while (feature[at] >= 0).any():
            f = feature[at]
            below = x[np.arange(len(x)), f] <= cut[at]
            at = np.where(f < 0, at, np.where(below, left[at], right[at]))
        return at

    def split(self, k: int, f: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[k], self.cut[k], self.left[k], self.right[k] = f, cut, len(self.value), len(self.value) + 1
        for v in values:
            for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, v)):
                column.append(new)
        return self.left[k], self.right[k]

    def rows(self) -> list[tuple]:
        return [(f, float(GRID[f][c]) if f >= 0 else 0.0, a, b, v) for f, c, a, b, v in zip(self.feature, self.cut, self.left, self.right, self.value)]


def chosen(tree: int, node: int) -> np.ndarray:
    """The features that a node may be split by."""
    return np.random.default_rng([7, tree, node]).choice(FEATURES, 4, replace=False)


def grow(cells: DataFrame, trees: int, depth: int, mean: float, least: int = 3) -> list[list[tuple]]:
    """Trees on `cells` (cell: the features' bins, label, weights: one a tree), one aggregate per level.

    A level's sums are numbers of (tree, node, one of four features, bin): as many at most, whatever the findings.
    """
    state = [Growth() for _ in range(trees)]
    for level in range(depth):
        if not any(g.open for g in state):
            break

        def sums(batches, state=state):
            total = {(t, k, f): np.zeros((2, BINS)) for t, g in enumerate(state) for k in g.open for f in chosen(t, k)}
            for b in batches:
                x = np.frombuffer(b"".join(b.column("cell").to_pylist()), "u1").reshape(-1, FEATURES)
                w = np.frombuffer(b"".join(b.column("weights").to_pylist()), "i8").reshape(-1, trees)
                y = b.column("label").to_numpy(zero_copy_only=False)
                for t, g in enumerate(state):
                    at = g.place(x)
                    for k in g.open:
                        here = np.flatnonzero(at == k)
                        for f in chosen(t, k):
                            for c, v in enumerate((w[here, t], w[here, t] * y[here])):
                                total[t, k, f][c] += np.bincount(x[here, f], v, BINS)
            out = [(t, k, int(f), int(j), int(h[0, j]), int(h[1, j])) for (t, k, f), h in total.items() for j in np.flatnonzero(h[0])]
            names = ["tree", "node", "feature", "bin", "n", "positive"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(6)], names)

        rows = (arrow_map(cells, sums, "tree long, node long, feature long, bin long, n long, positive long").groupBy("tree", "node", "feature", "bin")
                .agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toArrow())
        tables: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for t, k, f, j, n, positive in zip(*(rows.column(c).to_pylist() for c in rows.column_names)):
            tables.setdefault((t, k), {}).setdefault(f, np.zeros((2, BINS)))[:, j] = n, positive
        for t, g in enumerate(state):
            now, g.open = g.open, []
            for k in now:
                found = tables.get((t, k))
                if not found:  # a draw without rows
                    g.value[k] = mean
                    continue
                n, positive = next(iter(found.values())).sum(axis=1)
                p = positive / n
                g.value[k], best = float(p), (p * (1 - p) * n - 1e-9, None)
                for f in chosen(t, k) if n >= 2 * least and 0 < p < 1 else ():
                    n1, a = found[f].cumsum(axis=1)[:, :len(GRID[f])]
                    n2, b = n - n1, positive - a
                    cost = np.where((n1 >= least) & (n2 >= least), a * (1 - a / np.maximum(n1, 1)) + b * (1 - b / np.maximum(n2, 1)), np.inf)
                    j = int(cost.argmin())
                    if cost[j] < best[0]:
                        best = (cost[j], (int(f), j, ((n1[j], a[j]), (n2[j], b[j]))))
                if best[1]:
                    f, j, parts = best[1]
                    children = g.split(k, f, j, tuple(float(a / m) for m, a in parts))
                    g.open += [c for c, (m, a) in zip(children, parts) if m >= 2 * least and 0 < a < m]
    return [g.rows() for g in state]


def with_known(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (own and others), a stored table, with `known`: the runs of letters of `own` that are words."""
    keyed = rows.withColumn("__key", F.md5(F.col("own").cast("binary")))
    runs = keyed.select("__key", F.explode(F.regexp_extract_all(F.lower("own"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    known = runs.join(words, "word").groupBy("__key").agg(F.collect_list("word").alias("known"))
    return keyed.join(known, "__key", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))).drop("__key")


def marked_in(docs: DataFrame) -> DataFrame:
    """Distinct (own, before, label) of all texts: labelled findings, and every word once, with label 2."""
    def step(batches):
        for b in batches:
            found, words = set(), set()
            for text in b.column("text").to_pylist():
                found.update((text[s:e], before, label(text[s:e], before)) for s, e, before in candidates(text))
                words.update(re.findall(r"\b[a-z]{3,}\b", text.lower()))
            rows = [r for r in found if r[2] is not None] + [(w, "", 2) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["own", "before", "label"])

    texts = docs.select("text").where(F.col("text").isNotNull())
    return stored(arrow_map(texts, step, "own string, before string, label int").distinct(), "findings")


def examples_of(findings: DataFrame) -> DataFrame:
    """own, named, label, n: each finding once with what stands before it and once without, so that the string itself is judged too."""
    def step(batches):
        for b in batches:
            own, before, given = (b.column(c).to_pylist() for c in ("own", "before", "label"))
            told = [named(x or "") for x in before] + [False] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(own * 2, pa.string()), pa.array(told, pa.bool_()), pa.array(given * 2, pa.int32())], ["own", "named", "label"])

    rows = arrow_map(findings.select("own", "before", F.col("label").cast("int").alias("label")).where("label in (0, 1)"), step, "own string, named boolean, label int")
    return stored(rows.groupBy("own", "named", "label").agg(F.count(F.lit(1)).alias("n")), "examples")


def transitions(words: DataFrame) -> dict[str, float]:
    """Logarithm of the share of each pair of letters in the words, each word counted once."""
    def step(batches):
        counts = np.zeros(676, "i8")
        for b in batches:
            for w in b.column("word").to_pylist():
                codes = np.frombuffer(w.encode(), "u1").astype("i8") - 97
                counts += np.bincount(codes[:-1] * 26 + codes[1:], minlength=676)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([chr(97 + k // 26) + chr(97 + k % 26) for k in at], pa.string()), pa.array(counts[at])], ["pair", "n"])

    counts = {r["pair"]: r["n"] for r in arrow_map(words, step, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 676 at most
    total = sum(counts.values()) + 1
    return {k: math.log10(v / total) for k, v in counts.items()}


def train(docs: DataFrame, findings: DataFrame | None = None, trees: int = 25, depth: int = 6) -> Forest:
    """Fit on labelled findings (own, before, label), or on those that `label` marks in the texts; on all of them.

    A tree's bootstrap gives each finding a Poisson weight. Splits lie on `GRID`.
    """
    marked = marked_in(docs)
    words = marked.where("label = 2").select(F.col("own").alias("word"))
    pairs = transitions(words)

    def binned(batches):
        for b in batches:
            x = [described(own, told, pairs, frozenset(known)) for own, told, known in zip(*(b.column(c).to_pylist() for c in ("own", "named", "known")))]
            x = np.array(x, "f8").reshape(-1, FEATURES)
            bins = np.stack([np.searchsorted(g, x[:, f]) for f, g in enumerate(GRID)], axis=1).astype("u1")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("label"), b.column("n")], ["cell", "label", "n"])

    def weighted(batches):
        for b in batches:
            drawn = [np.random.default_rng([7, zlib.crc32(cell), y]).poisson(n, trees).astype("i8").tobytes()
                     for cell, y, n in zip(*(b.column(c).to_pylist() for c in ("cell", "label", "n")))]
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("label"), b.column("n"), pa.array(drawn, pa.binary())], ["cell", "label", "n", "weights"])

    examples = with_known(examples_of(marked.where("label < 2") if findings is None else findings), words)
    cells = arrow_map(examples, binned, "cell binary, label int, n long").groupBy("cell", "label").agg(F.sum("n").alias("n"))
    cells = stored(arrow_map(cells, weighted, "cell binary, label int, n long, weights binary"), "cells")
    n, positive = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("label"))).first()
    mean = positive / n if n else 0.0
    if mean in (0.0, 1.0):
        return Forest([[(-1, 0.0, 0, 0, float(mean))]], pairs, Words(words))
    return Forest(grow(cells, trees, depth, mean), pairs, Words(words))


def secret_spans(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Secrets in every text.

    One row per row of `docs` (doc_id, text; other columns are not read): doc_id, n_candidates, n_secrets, spans
    (start:end in code points, comma-joined). A null or empty text has none. An empty table gives an empty table.
    A string is judged once for all its places.
    """
    model = docs.sparkSession.sparkContext.broadcast((forest.trees, forest.pairs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("own", pa.string()), ("named", pa.bool_())])

    def step(batches):
        for b in batches:
            items = [[{"start": s, "end": e, "own": text[s:e], "named": named(before)} for s, e, before in candidates(text)] if text else [] for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(items, pa.list_(item))], ["doc_id", "items"])

    def judge(batches):
        m = Forest(*model.value, words=None)
        for b in batches:
            told = zip(*(b.column(c).to_pylist() for c in ("own", "named", "known")))
            secret = [m.score(described(own, is_named, m.pairs, frozenset(known))) >= threshold for own, is_named, known in told]
            yield pa.RecordBatch.from_arrays([b.column("own"), b.column("named")], ["own", "named"]).filter(pa.array(secret, pa.bool_()))

    out = arrow_map(docs.select("doc_id", "text"), step, f"doc_id {kind}, items array<struct<start: int, end: int, own: string, named: boolean>>")
    out = stored(out.withColumn("__row", F.monotonically_increasing_id()), "candidates")
    found = out.select("__row", F.explode("items").alias("i")).select("__row", "i.*")
    strings = stored(found.select("own", "named").distinct(), "strings")
    secrets = arrow_map(with_known(strings, forest.words.table), judge, "own string, named boolean")
    spans = found.join(secrets, ["own", "named"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = out.select("__row", "doc_id", F.size("items").cast("long").alias("n_candidates")).join(spans, "__row", "left")
    written = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return rows.select("doc_id", "n_candidates", F.coalesce(F.array_size("spans"), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(F.array_join(written, ","), F.lit("")).alias("spans"))


@llm_query
def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf, "documents")
    return secret_spans(docs, train(docs))
