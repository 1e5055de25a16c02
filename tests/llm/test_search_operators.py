"""Fingerprints, collocations and hard negatives against brute force, and the cases each of them defines."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from augurmill.llm import hardneg, phrases, simhash
from augurmill.oracle.compare import compare, duck

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [(7, "one two three four five six"), (7, "one two three four five six"), (None, "mail a.b@c.de now"), (2, None), (3, ""), (4, LONG), (None, None), (5, " \n\t "), (6, "é ü 中文 😀"), (9, "x" * 5000)]
CLASHING = "doc_id long, text string, slice string, row int, n_chars double, h string, w string, f0 string, copy string"


# --- fingerprints

def terms_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    for a, b in zip([None, *words], words):
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42) if a is not None else 42)
        yield h, min(15, len(b) + len(a or ""))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(text, bits):
    out = []
    for part in range(bits // 64):
        votes = [0] * 64
        total = 0
        for h, w in terms_of(text):
            # a number hashes as its eight bytes, then the part's four on top of it
            own = h if part == 0 else xxhash.xxh64_intdigest(part.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            total += w
            for i in range(64):
                votes[i] += w * (own >> i & 1)
        out.append(signed(sum(1 << i for i in range(64) if 2 * votes[i] > total)))
    return out


def neighbours(rows):
    """(doc_id, text, next text) in order; a null id first."""
    own = sorted(((i is not None, i or 0, t or "", i) for i, t in rows))
    return [(x[3], x[2], own[(k + 1) % len(own)][2]) for k, x in enumerate(own)]


def apart(a, b):
    return sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b))


@pytest.mark.parametrize("slice_rows", [500, 2, 1])
def test_fingerprints(spark, slice_rows):
    df = spark.createDataFrame([(i, t, "s", 1, 2.0, "h", "w", "f", "c") for i, t in ODD], CLASHING)
    got = simhash.fingerprints(df, 64, slice_rows).collect()
    want = []
    for i, text, after in neighbours(ODD):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        f, e, n = fingerprint_of(text, 64), fingerprint_of(edited, 64), fingerprint_of(after, 64)
        like = lambda x: max(0.0, math.cos(apart(f, x) * math.pi / 64))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), f[0], e[0], round(like(e), 9), round(like(n), 9)))
    assert sorted(map(str, want)) == sorted(str((*r[:5], round(r[5], 9), round(r[6], 9))) for r in got)
    assert simhash.fingerprints(df.limit(0)).count() == 0
    one = simhash.fingerprints(df.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_fingerprints_of_two_words_and_a_long_text(spark):
    rows = [(k, " ".join(random.Random(k).choice("abcdefgh") * 3 for _ in range(9000))) for k in range(3)]
    got = {r.doc_id: (r.f0, r.f1) for r in simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 128).collect()}
    assert got == {k: tuple(fingerprint_of(t, 128)) for k, t in rows}


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 6), (6, 8), (1, 3)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius * 10 + blocks)
    base = [rng.getrandbits(128) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, radius + 2))) for b in base for _ in range(8)]
    rows = [(i, signed(x & (1 << 64) - 1), signed(x >> 64)) for i, x in enumerate([*base, *near, *near[:30], 0, 0, 1])]
    df = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long")
    got = {(r.f0, r.f1): (r.n_same, r.n_near) for r in simhash.within_radius(df, F.col("doc_id") % 5 == 0, radius, blocks).collect()}
    want = {}
    for i, *f in rows:
        if i % 5 == 0:
            gaps = [apart(f, g) for _, *g in rows]
            want[tuple(f)] = (gaps.count(0), sum(0 < x <= radius for x in gaps))
    assert got == want and sum(n for _, n in want.values()) > 20
    assert simhash.within_radius(df.limit(0), F.lit(True)).count() == 0


def test_fingerprint_query(spark):
    rows = entry.queries()["op11_fingerprints"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    by_id = {i: (t, n) for i, t, n in neighbours([(d.doc_id, d.text) for d in docs])}
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(by_id)
    for r in rows:
        text, after = by_id[r.doc_id]
        cut = len(text) // 4
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert (r.n_near is not None) == (r.doc_id % 50 == 0) and len(r.fingerprint) == len(r.edited_fingerprint) == 32
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)


def test_fingerprints_use_no_python_and_one_shuffle_of_texts(spark):
    plan = simhash.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not re.search("Python|Arrow|Pandas", plan)


# --- collocations

def brute_phrases(rows, least):
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                f.update((lang or "und", words[i:i + k]) for i in range(len(words) - k + 1))
    out = collections.defaultdict(list)
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i:i + m]] = max(inside[lang, p[i:i + m]], a)
    for (lang, p), a in often.items():
        if 100 * inside[lang, p] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:2000], 1))


def test_collocations(spark):
    rng = random.Random(3)
    pool = ["a", "B", "b", "c", "new york", "x.y", "\x1c", "é", "中文 字", "d,", "  ", "\t", "!\n", "e"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("fr", "hot pair " * 3000), ("fr", "only once")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, n int, word string, a long").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert got == brute_phrases(rows, 30) and len(got) > 50
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df, least=10_000_000).count() == 0


def test_collocation_query_equals_sql(spark):
    assert compare(entry.queries()["op12_collocations"](spark, SF), entry.oracle_sql()["op12_collocations"], duck(SF)).startswith("ok")


def test_streams_cut_long_texts_without_a_loss(monkeypatch):
    """Small buffers, and every pair hot or none: suffixes of all streams give the counts of all phrases."""
    monkeypatch.setattr(phrases, "FLUSH_WORDS", 7)
    monkeypatch.setattr(phrases, "CHUNK", 9)
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de"]), " ".join(rng.choice(["a", "b", "c.", "d"]) for _ in range(rng.randint(0, 80)))) for _ in range(30)]
    batch = pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})
    every, none = np.full(phrases.ENTRIES // 8, 255, "u1"), np.zeros(phrases.ENTRIES // 8, "u1")
    want = collections.Counter()
    for lang, text in rows:
        for piece in text.split("."):
            words = tuple(piece.split())
            for k in range(2, 5):
                want.update((lang, words[i:i + k]) for i in range(len(words) - k + 1))
    for hot in (none, every):
        got = collections.Counter()
        for ids, upto, names in phrases.streams(iter([batch])):
            h = np.arange(len(names)).astype("u8")
            words, n, only = phrases.suffixes(ids, upto, h, every, hot)
            for length in np.unique(only).tolist():
                use = only == length
                part = words[:, use].astype("u8")
                for at, k, a in phrases.quicksort(part, n[use], 1, length or 2, length or 4):
                    got[names[words[0, use][at]][0], tuple(names[w][1].decode() for w in words[:k, use][:, at])] += a
        assert got == want


def test_quicksort_counts_and_abandons():
    rng = np.random.default_rng(1)
    columns, weight = rng.integers(0, 4, (4, 3000)).astype("u8"), rng.integers(1, 5, 3000)
    for j in range(1, 4):  # a suffix that has ended has no more words
        columns[j][columns[j - 1] == 0] = 0
    want = collections.Counter()
    for row, w in zip(columns.T.tolist(), weight.tolist()):
        for k in range(2, 5):
            if all(row[:k]):
                want[tuple(row[:k])] += w
    got = {tuple(columns[:k, at].tolist()): a for at, k, a in phrases.quicksort(columns, weight, 40, 2, 4)}
    assert got == {p: a for p, a in want.items() if a >= 40} and len(got) < len(want)


# --- hard negatives

def brute_negatives(rows, anchor):
    q = lambda v: [math.floor(256 * float(x)) for x in v]
    own = [(i, lab, q(v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    first = {}
    for i, lab, v in own:
        if anchor(i):
            first[i] = min(first.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in first.items():
        for ps, p in sorted((-dot(v, w), j) for j, m, w in own if j != i and m == lab)[:5]:
            found = sorted((-dot(v, w), j) for j, m, w in own if j != i and m != lab and 30 * -ps <= 100 * dot(v, w) <= 90 * -ps)[:10]
            out += [(i, p, rank, j, -ps, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 2e6])
def test_hard_negatives(spark, scale):
    """Small leaves; nulls, gaps, equal vectors, repeated rows, short vectors; numbers beyond doubles."""
    rng = random.Random(int(scale))
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, i % 3, [scale * (c + rng.gauss(0, 0.3)) for c in centres[i % 5]]) for i in range(220)]
    rows += [(300 + i, i % 2, [scale] * 6) for i in range(60)] + [(10, 1, [0.5 * scale] * 6), (10, 1, [0.5 * scale] * 6), (20, 0, [0.1, 0.2]), (30, 1, []), (40, 1, None), (None, 1, [1.0] * 6), (50, None, [1.0] * 6), (60, 1, [None] * 6), (70, 1, [float("nan")] * 6), (80, 1, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, label int, vector array<double>, score string, rank int").repartition(3)
    got = hardneg.hard_negatives(df, F.col("id") % 10 == 0, leaf_rows=20, fan=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    assert hardneg.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hardneg.hard_negatives(df, F.lit(False)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        hardneg.hard_negatives(df.withColumn("vector", F.transform("vector", lambda v: v * 1e12)), F.col("id") % 10 == 0).count()


def test_ranges_eliminate_leaves_and_lose_none():
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(0, 1, (8, 10))[rng.integers(0, 8, 4000)] * 4 + rng.normal(0, 0.3, (4000, 10))))
    tree, seen = hardneg.grow(x[:1000], 4000, 8, 100), {}
    leaf = hardneg.place(tree, x, seen)
    for at in range(len(tree.points)):
        low, high, norms = seen.get(at)
        tree.near.append(np.sqrt(low)), tree.far.append(np.sqrt(np.maximum(high, 0))), tree.norms.append(norms)
    s = x[:50] @ x.T
    top = np.sort(s, 1)[:, -10]
    met = hardneg.meets(tree, x[:50], top, np.full(50, np.inf), len(tree.leaf_points))
    assert all(met[i, leaf[s[i] >= top[i]]].all() for i in range(50))
    assert met.mean() < 0.5


def test_hard_negative_query_equals_sql(spark):
    assert compare(entry.queries()["op13_hard_negatives"](spark, SF), entry.oracle_sql()["op13_hard_negatives"], duck(SF)).startswith("ok")
