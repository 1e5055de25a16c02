"""The text operators against brute force, and the cases every one of them defines."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from augurmill.llm import decontam, html, lm, neardup, packing, private, quality, secrets, tokens, toxicity
from augurmill.llm.common import words_of
from augurmill.oracle.compare import compare, duck

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "mail a.b@c.de now"), (2, None), (3, ""), (4, LONG), (None, None), (5, " \n\t "), (6, "é ü 中文 😀")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, a very long text, and columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, 2.0, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string, n_words int, score double, spans string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.tokenizer_path(), tokens.ranks_path())


POOL = ["a", "b", "word", " ", "  ", "\n", "\t", "\r\n", "'s", "'", "é", "<|endoftext|>", "<|", "1", ".", "\xa0", "中", "\x1c", "\x85", "½", "😀"]


def test_ids_and_long_counts_equal_the_library(encoder):
    rng = random.Random(1)
    plain = lambda x: encoder.library.encode(x, add_special_tokens=False).ids
    for _ in range(3000):
        x = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 14)))
        assert encoder.ids(x) == plain(x)
    for _ in range(500):
        x = "".join(rng.choice(POOL) for _ in range(rng.randint(0, 200)))
        assert tokens.count_long(x, encoder, rng.randint(5, 60), rng.randint(1, 20)) == len(plain(x))


def test_token_counts(odd, none, encoder):
    got = tokens.token_counts(odd, tokens.tokenizer_path(), tokens.ranks_path(), chunk=3000, overlap=64).collect()
    want = [(i, len((t or "").encode()), len(encoder.library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)
    assert tokens.token_counts(none, tokens.tokenizer_path()).count() == 0


def test_packing_round_trip(odd, none, encoder):
    rows = packing.pack(odd, tokens.tokenizer_path(), tokens.ranks_path(), window=64, with_ids=True).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter(len(encoder.ids(t or "")) + 1 for _, t in ODD)
    assert sum(r.length for r in rows) == sum(k * v for k, v in want.items())
    assert packing.pack(none, tokens.tokenizer_path()).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    lengths = [rng.randint(1, 40) for _ in range(400)]
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in left if c >= n]
        if fit:
            left.remove(min(fit))
        left.append((min(fit) if fit else 64) - n)
    assert len(left) == max(w for w, _ in packing.best_fit_decreasing(lengths, 64)) + 1


def test_marginals_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng, lengths = np.random.default_rng(0), [1, 5, 3, 9, 2]
    n = sum(lengths)
    e, trans, starts = rng.normal(size=n) * 2, rng.normal(size=(2, 2)), np.zeros(n, bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    want, at = [], 0
    for k in lengths:
        total, own = 0.0, np.zeros(k)
        for ys in itertools.product((0, 1), repeat=k):
            w = math.exp(sum(e[at + i] * y for i, y in enumerate(ys)) + sum(trans[ys[i], ys[i + 1]] for i in range(k - 1)))
            total, own = total + w, own + w * np.array(ys)
        want += list(own / total)
        at += k
    assert np.abs(toxicity.marginals(e, trans, starts) - want).max() < 1e-12


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.95 * len(rows)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.02 * len(rows)


def test_toxicity_cases(odd, none, spark):
    field = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = toxicity.toxicity(odd, field).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 for r in rows) and toxicity.toxicity(none, field).count() == 0


@pytest.mark.parametrize("name", ["op3_decontamination", "op8_quality_rules"])
def test_queries_against_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], duck(SF)).startswith("ok")


def test_contamination_cases(odd, none, spark):
    bench = spark.createDataFrame([(1, "two THREE"), (1, "two THREE"), (2, None), (None, "w1 w2"), (3, "...")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): r for r in decontam.contamination(odd, bench).collect()}
    assert rows[1, 6].n_hit == 2 and rows[1, 6].item_ids == ["1"] and rows[1, 6].contaminated
    assert rows[4, 40_000].n_items == 0 and rows[4, 40_000].n_hit > 0
    assert rows[3, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontam.contamination(none, bench).count() == 0 and decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_in_blocks_of_items(odd, spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)], "item_id long, text string")
    whole = decontam.contamination(odd, bench).drop("item_ids").collect()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 40)
    assert sorted(map(str, whole)) == sorted(map(str, decontam.contamination(odd, bench).drop("item_ids").collect()))


def test_quality_cases(odd, none):
    rows = quality.quality(odd, order=list(quality.RULES)).collect()
    assert len(rows) == len(ODD) and sum(r.kept for r in rows) <= 1 and quality.quality(none).count() == 0
    plan = quality.quality(odd, order=list(quality.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_classes(texts):
    bags = []
    for t in texts:
        w = words_of((t or "").encode())
        k = min(5, len(w))
        bags.append(collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else None)
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if bags[i] and bags[j]:
            low, high = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if low >= 0.8 * high and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    want = brute_classes([r.text for r in docs])
    least = {}
    for r, c in zip(docs, want):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    got = {r.doc_id: r.class_id for r in entry.queries()["op5_near_duplicates"](spark, SF).collect()}
    assert got == {r.doc_id: least[c] for r, c in zip(docs, want)}


def test_near_duplicate_cases(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and sum(r.first for r in rows) == len(ODD) - 1  # the repeated row
    assert neardup.near_duplicates(none).count() == 0


def test_near_pairs_among_texts_of_one_template_are_found(spark, tmp_path):
    template = " ".join(f"t{i}" for i in range(170))
    # similarity of two texts with 30 own words each is 0.73, of such a text and one with 17 is 0.78, of two with 17 is 0.83
    rows = [(k, " ".join(f"o{k}x{i}" for i in range(17 if k in (700, 900) else 30)) + " " + template) for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert got == {k: 700 if k == 900 else k for k in range(2000)}


def test_signatures_estimate_weighted_similarity():
    a, b = {i: 1 + i % 5 for i in range(200)}, {i: 1 + (i * 7) % 4 for i in range(60, 260)}
    h = lambda d: np.array([zlib.crc32(str(k).encode()) * 2654435761 % 2**64 for k in d], "u8")
    sig = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([h(a), h(b)]), np.array([*a.values(), *b.values()]), 2, 4096)
    keys = {*a, *b}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_lm_base_score_and_held_out_gain(spark):
    rows = {r.doc_id: r for r in entry.queries()["op7_lm_scoring"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for i, t in docs.items()}
    c = collections.Counter(w for i in docs if not held[i] for w in words[i])
    n = sum(c.values())
    for i, r in rows.items():
        assert r.held_out == held[i] and r.train_tokens == n and r.n_tokens == len(words[i]) and r.n_known == sum(c[w] > 0 for w in words[i])
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in words[i]), rel=1e-9)
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_every_seen_bigram_has_its_arc(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 3 == 0)
    words = {r.doc_id: (r.held_out, [None, *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), "\n"]) for r in docs.collect()}
    train = [w for held, w in words.values() if not held]
    c, both = collections.Counter(x for w in train for x in w[1:]), collections.Counter(p for w in train for p in itertools.pairwise(w))
    n, less = sum(c.values()), lambda k: (s := list(k.values())).count(1) / (s.count(1) + 2 * s.count(2))
    d, e = less(c), less(both)
    uni = lambda x: max(c[x] - d, 0) / n + d * len(c) / n / (len(c) + 1)
    seen, taken, below = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, x), k in both.items():
        seen[h], taken[h], below[h] = seen[h] + k, taken[h] + k - e, below[h] + uni(x)

    def log(h, x):
        return math.log10((both[h, x] - e) / seen[h] if (h, x) in both else uni(x) * ((1 - taken[h] / seen[h]) / (1 - below[h]) if h in seen else 1))

    for r in lm.lm_scores(docs).collect():
        assert r.score == pytest.approx(sum(itertools.starmap(log, itertools.pairwise(words[r.doc_id][1]))), rel=1e-9)


def test_lm_blocks_ask_parts_for_counts_and_states(monkeypatch):
    """Packed rows of blocks and parts, a frequent word's bigrams in several parts, against plain counters."""
    monkeypatch.setattr(lm, "HOT_TOKENS", 50)
    rng, parts = np.random.default_rng(5), 5
    texts_ = [[rng.integers(0, 400, 60) ** 2 // 400 for _ in range(40)] for _ in range(3)]
    held = [[i % 4 == 0 for i in range(40)] for _ in range(3)]
    lists, own = [], []
    for k, block in enumerate(texts_):
        numbers = {w: i for i, w in enumerate(sorted({int(w) for t in block for w in t}))}
        own.append(pa.table({"block": [k] * 40, "held_out": held[k], "ids": pa.array([lm.pack(np.array([numbers[int(w)] for w in t])) for t in block], pa.binary())}))
        words = [*(b"w%d" % w for w in numbers), lm.START]
        c = collections.Counter(b"w%d" % w for t, h in zip(block, held[k]) for w in t if not h) + collections.Counter({lm.START: 40 - sum(held[k])})
        for bucket in range(parts):
            at = [i for i, w in enumerate(words) if zlib.crc32(w) % parts == bucket]
            lists.append((bucket, k, b"\t".join(words[i] for i in at), lm.pack_sorted(np.array(at)), lm.pack(np.array([c[words[i]] for i in at]))))
    table = lambda rows, names: pa.table([pa.array(x) for x in zip(*rows)], names)
    known = pa.concat_tables([lm.numbered(table([r for r in lists if r[0] == b], ["bucket", "block", "words", "n", "c"]), parts) for b in range(parts)])
    of_block = [known.filter(pc.equal(known["block"], k)) for k in range(3)]
    asks = pa.concat_tables([lm.asked(t, w, parts) for t, w in zip(own, of_block)])
    answers = pa.concat_tables([lm.answered(asks.filter(pc.equal(asks["part"], k))) for k in range(parts)])
    both, c = collections.Counter(), collections.Counter()
    for block, hs in zip(texts_, held):
        for t, h in zip(block, hs):
            if not h:
                both.update(itertools.pairwise([-1, *map(int, t)]))
                c.update(map(int, t))
    assert pc.sum(known["tokens"]).as_py() == sum(c.values()) and pc.sum(known["types"]).as_py() == len(c)
    assert [pc.sum(answers[x]).as_py() for x in ("once", "twice")] == [list(both.values()).count(k) for k in (1, 2)]
    for k, block in enumerate(texts_):
        b = lm.Block(own[k], of_block[k], parts)
        names = [*sorted({int(w) for t in block for w in t}), -1]
        counts, followers, below = np.zeros(len(b.codes)), np.zeros(len(b.c)), np.zeros(len(b.c))
        for r in answers.filter(pc.equal(answers["block"], k)).to_pylist():
            counts[b.part == r["part"]] = lm.unpack(r["counts"])
            np.add.at(followers, b.state[b.state_part == r["part"]], lm.unpack(r["followers"]))
            np.add.at(below, b.state[b.state_part == r["part"]], lm.unpack(r["c2"]))
        assert [both[names[x], names[y]] for x, y in zip(b.left, b.right)] == counts.tolist()
        assert max(collections.Counter(b.state.tolist()).values()) > 1
        for i, w in enumerate(names):
            after = [y for x, y in both if x == w]
            assert (followers[i], below[i]) == (len(after), sum(c[y] for y in after))
    x = np.sort(rng.integers(0, 1 << 40, 1 << 17))
    assert (lm.unpack_sorted(lm.pack_sorted(x)) == x).all() and len(lm.unpack(lm.pack(np.zeros(0, "i8")))) == 0


def test_automaton_states_sum_to_one():
    m = lm.Automaton(100, 10, 3, 2, np.array([30, 20]), 10, np.array([0, 1, 3, 6]), np.array([8, 4, 5, 6]))
    c = np.array([30.0, 20.0, 9, 9, 8, 8, 6, 5, 3, 2])
    ids = np.arange(10)
    for first in (0, 1):
        p = [10 ** m.score(np.array([first, i]), np.array([True, False]), c)[1] for i in ids]
        rest = 10 ** m.fail[first] * m.rest  # all unseen words as one
        assert sum(p) + rest == pytest.approx(1, abs=1e-9)


def test_lm_cases(odd, none):
    rows = lm.lm_scores(odd.withColumn("held_out", F.col("doc_id") == 4)).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert lm.lm_scores(none.withColumn("held_out", F.lit(False))).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def test_base_spans_against_plain_patterns():
    rng, pool = random.Random(4), ["a", "b.c", "@", "@d.e", "1", "300", ".", "1.2.3.4", " ", "-", "+1", "(", ")", "4111111111111111", "é", "\n", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        want = []
        for kind, p in BASE.items():
            for m in re.finditer(p, t):
                digits = re.sub(r"[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and private.luhn(digits), "phone": 9 <= len(digits) <= 15}
                if ok[kind]:
                    want.append((list(BASE).index(kind), *m.span()))
        assert private.base_spans(t) == want, t


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    assert private.base_spans("0" * 5000 + ".1.1.1 x") == [(1, 0, 5006)]
    assert private.base_spans("1" * 300_000) == [] and private.base_spans("9" * 5000 + ".1.1.1") == []
    long = "中" * 300_000 + " 1"
    assert private.instances(long, private.base_spans(long)) == []
    assert private.base_spans("1.2.3.4.5.6.7.8") == [(1, 0, 7), (1, 8, 15)]
    assert time.perf_counter() - began < 5


def test_contexts_reveal_unseen_identifiers(spark):
    seeds = [(i, f"my account mail user{i}@host{i}.example") for i in range(6)]
    docs = spark.createDataFrame([*seeds, (90, "my account mail QX-77341-Z now"), (91, "my account mail QX-77341-Z now"), (92, "room number QX-77342-Z")], "doc_id long, text string")
    found = {r.doc_id: [tuple(s) for s in r.found_spans] for r in private.personal_data(docs, confidence=0.5).collect()}
    assert found[90] == found[91] == [(4, 16, 26)] and not found[92] and not found[0]


def test_personal_data_cases(odd, none):
    rows = private.personal_data(odd).collect()
    assert len(rows) == len(ODD) and sum(len(r.base_spans) for r in rows) == 1 and private.personal_data(none).count() == 0


def test_secrets_on_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    forest = secrets.train(docs.where("doc_id % 2 = 0"))
    right = collections.Counter()
    for r in docs.where("doc_id % 2 = 1").select("text").collect():
        for s, e, before in secrets.candidates(r.text):
            known = secrets.label(r.text[s:e], before)
            if known is not None:
                right[known, forest.score(secrets.features(r.text[s:e], before, forest.pairs, forest.words)) >= 0.5] += 1
    assert right[1, True] >= 0.9 * (right[1, True] + right[1, False]) and right[0, False] >= 0.98 * (right[0, True] + right[0, False])
    assert secrets.secret_spans(odd, forest).count() == len(ODD) and secrets.secret_spans(none, forest).count() == 0
    assert secrets.train(none).score([0.0] * secrets.FEATURES) == 0


def test_secrets_learn_from_all_texts(spark):
    """Words behind the first 200 and of more than 8,000 texts, and more than 4,000 findings of a label."""
    letters = lambda i: "".join(chr(97 + i // 26 ** k % 26) for k in range(4))
    docs = spark.range(9000).rdd.map(lambda r: (r.id, "filler " * 250 + f"zq{letters(r.id)} password={r.id:08d}x7Kp9Lm2 or {letters(r.id)}@mail.example")).toDF("doc_id long, text string")
    forest = secrets.train(docs, trees=3)
    assert all(f"zq{letters(i)}" in forest.words for i in (0, 4321, 8999))
    marked = secrets.marked_in(docs)
    assert marked.where("label = 2 and own like 'zq____'").count() == 9000
    assert {r["label"]: r["n"] for r in secrets.examples_of(marked.where("label < 2")).groupBy("label").agg(F.sum("n").alias("n")).collect()} == {0: 18000, 1: 18000}


def test_secrets_at_once_equal_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.limit(50)).select("doc_id", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, "see mail/example.com/die9the/x or token=q8w7e6r5t4y3u2i1")).alias("text"))
    forest = secrets.train(docs)
    words = {r.word for r in forest.words.table.collect()}
    want = collections.Counter()
    for r in docs.collect():
        found = secrets.candidates(r.text or "")
        kept = [f"{s}:{e}" for s, e, before in found if forest.score(secrets.features(r.text[s:e], before, forest.pairs, words)) >= 0.5]
        want[r.doc_id, len(found), len(kept), ",".join(kept)] += 1
    assert collections.Counter(map(tuple, secrets.secret_spans(docs, forest).collect())) == want and any(k[2] for k in want)


def test_html_layout():
    page = ("<html><head><title>T</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b><p>Three&amp;four<br>five"
            "<ul><li>a<li>b<ol><li>c</ol></ul><table><tr><th>k<th>value<tr><td>long cell<td>1</table><p hidden>no<p style='display:none'>no"
            "<script>var t='</p>'</script><pre> x\n  y</pre>end")
    assert html.visible_text(page) == "\n".join([
        "Head", "", "One two", "", "Three&four", "five", "", "- a", "- b", "  1. c", "", "k          value", "long cell  1", "", " x", "  y", "", "end"])
    assert html.visible_text("") == "" and html.visible_text("<b>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize("page, text", [
    ("<table><tbody><td>a<td>b</table>", "a  b"), ("<table><td>a</table>", "a"), ("<table><tr><form><td>a</td></form></tr></table>z", "a\n\nz"),
    ("<table><tr>stray <b>bold</b><td>a</table>", "stray bold\n\na"), ("<table><tr><td>a<tbody><tr><td>b</table>", "a\nb"),
    ("<div>x<table><tr><td>a</div>b</td><td>c</table>", "x\n\nab  c"),
    ("<head><title>x</title><p>All text", "All text"), ("<head><meta name=a>bare", "bare"), ("<head><style>p{}</style></head><p>a", "a"),
    ("<p class='menu hidden md:flex'>a", "a"), ("<p title='a hidden gem'>a", "a"), ("<img alt='the hidden valley'>", "the hidden valley"), ("<img data-alt=x alt=y>", "y"),
    ("<p title='display: none'>a", "a"), ("<p hidden=''>a", ""), ("<p style='color:red; DISPLAY : none !important'>a", ""), ("<p aria-hidden=true>a", ""),
    ("x <math><mi>y</mi><mo>=</mo><mn>2</mn></math>", "x y=2"), ("<svg><title>t</title><defs><text>no</text></defs><g><text>axis</text><path/></g></svg>", "axis"),
    ("<dialog open>a</dialog><dialog>b</dialog>", "a"), ("<object>a</object><object data=x.swf>b</object>", "a"),
])
def test_html_shows_what_a_browser_shows(page, text):
    assert html.visible_text(page) == text


def test_html_cases(spark):
    pages = spark.createDataFrame([(1, None, "z"), (None, "<p>a", "z"), (2, "", "z"), (2, "", "z")], "page_id long, html string, text string")
    assert sorted(r.text for r in html.page_texts(pages).collect()) == ["", "", "", "a"] and html.page_texts(pages.limit(0)).count() == 0


def test_texts_that_are_a_little_too_different_make_few_candidates(spark):
    """A large group below the similarity: a row for hardly any pair but the similar ones, and none of those is lost."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(80):
        own = list(base)
        for at in rng.sample(range(150), 4):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "__uid long, text string")
    bag = neardup.bag_table(docs, 5).cache()
    bags = {r.node: bytes(r.bag) for r in bag.collect()}
    true = {(i, j) for i in bags for j in bags if i < j and neardup.similarity(bags[i], bags[j]) >= 0.8}
    labels = bag.select("node", F.col("node").alias("label"))
    met = {(r.a, r.b) for r in neardup.exact_candidates(bag, labels, 0.8).collect()}
    assert true <= met and len(met) < len(true) + 0.1 * 80 * 79 / 2
