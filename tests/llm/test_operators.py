import collections
import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import common, jaccard, licenses, mixing, packing, pages, quality, queries, substring, suffix, topk, toxicity
from weir.operators import places

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# a null in every column, empty and blank texts, ties, equal rows, a very long text
EDGES = [
    (1, "one two three four five six", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 4), (5, "one two three four five six", "en", "a", 5),
    (5, "one two three four five six", "en", "a", 5), (None, "no id here", "en", None, 1), (7, "x", "de", "c", 1), (8, "Äpfel und Öl " * 9000, "de", "c", 1), (9, "Äpfel und Öl " * 9000, "de", "c", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS).withColumns({"id": F.lit(1), "part": F.lit("clash"), "bucket": F.lit(2), "sign": F.lit(3), "size": F.lit("s")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(name, spark, sf, same):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE[name])


# 1


def test_toxicity_learns_held_out_labels(spark, sf):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity.score(d, toxicity.fit(d, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit >= 0.9 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.5 * sum(r.toxic for r in rows)


def test_toxicity_scores_equal_plain_python(spark, edges):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(edges.select("doc_id", "text", "lang", "source", "n_chars"))
    model = toxicity.fit(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    known, bias = dict(zip(model[0].tolist(), model[1].tolist(), strict=True)), model[2]
    assert len(known) >= 5

    def plain(text):
        runs = {r for r in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())}
        hashes = [int(common.word_hashes(np.frombuffer(r, np.uint8), toxicity._BETWEEN)[2][0]) for r in runs]
        return 1 / (1 + math.exp(-max(-40, min(40, bias + sum(known.get(h, 0) for h in hashes)))))

    got = collections.Counter((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(d, model).collect())
    expected = collections.Counter((r.doc_id, round(p, 9), int(p >= 0.3)) for r in d.collect() for p in [plain(r.text)])
    assert got == expected


def test_toxicity_sample_is_bounded(spark):
    # one id on many rows, all with other texts, counts once; the bound on bytes drops whole texts
    rows = [(1, f"row {i} a b c") for i in range(200)] + [(k, "w " + " ".join(f"{chr(97 + j)}x{k}" for j in range(20))) for k in range(2, 12)]
    d = spark.createDataFrame(rows, "k long, text string")
    assert len(toxicity.presence(d)) == 11
    few = toxicity.presence(d, most=500)
    assert 0 < len(few) < 11 and sum(map(len, few)) * 8 <= 500
    assert toxicity.presence(d.limit(0)) == []


def test_toxicity_edges(spark, edges, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(edges, toxicity.fit(edges, labels)).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_nnpu_separates():
    rng = np.random.default_rng(1)
    pos = [np.unique(np.append(rng.integers(10, 200, 20), 5)).astype(np.uint64) for _ in range(80)]
    unl = [np.unique(np.append(rng.integers(10, 200, 20), [5] if i % 10 == 0 else [])).astype(np.uint64) for i in range(600)]
    w, weights, bias = toxicity.train(pos, unl, 0.1)
    assert 5 in w.tolist() and weights[w.tolist().index(5)] > 1 and bias < 0


# 2


def test_licenses_equal_brute_force(spark, sf, edges, none):
    d = docs(spark, sf)
    out = {r.doc_id: sorted(x.template for x in r.found) for r in licenses.scan(d).collect()}
    assert out == {r.doc_id: licenses.brute(r.text) for r in d.select("doc_id", "text").collect()}
    assert licenses.scan(edges).count() == len(EDGES) and licenses.scan(none).count() == 0


def test_license_with_edits_in_long_text(spark):
    filler = " ".join(f"w{i}" for i in range(3000))
    grant = licenses.TEMPLATES["MIT grant"]
    # a word near the start costs few shingles (0.83 of 23 stay), one in the middle five (0.78, a miss)
    near, far = grant.replace("is hereby", "is now").upper(), grant.replace("charge", "cost").upper()
    d = spark.createDataFrame([(1, f"{filler} {near} {filler}"), (2, filler), (3, f"{filler} {far} {filler}")], "doc_id long, text string")
    out = {r.doc_id: [x.template for x in r.found] for r in licenses.scan(d).collect()}
    assert out == {1: ["MIT grant"], 2: [], 3: []}


def test_licenses_are_told_apart_and_edits_found(spark):
    random.seed(2)
    filler = lambda: " ".join(f"w{random.randrange(500)}" for _ in range(400))
    rows, expected = [], {}
    for name, text in licenses.TEMPLATES.items():
        for k in range(8):
            words = text.split()
            for _ in range(k // 3):
                words[random.randrange(len(words))] = "edited"
            i = len(rows)
            rows.append((i, f"{filler()} {' '.join(words)} {filler()}"))
            expected[i] = licenses.brute(rows[-1][1])
            assert k > 2 or expected[i] == [name], (name, expected[i])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: sorted(x.template for x in r.found) for r in licenses.scan(d).collect()}
    wanted = sum(len(v) for v in expected.values())
    assert all(set(got[i]) <= set(licenses.TEMPLATES) for i in got)
    assert sum(len(set(got[i]) & set(expected[i])) for i in got) >= 0.99 * wanted and sum(got[i] == expected[i] for i in got) >= 0.99 * len(rows)


# 3


def base(text):
    w = words(text)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_base_and_score(spark, sf):
    d = docs(spark, sf)
    trusted = quality.trusted_ids(spark, sf)
    rows = {r.doc_id: r for r in quality.quality(d, trusted).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    good = {r.doc_id for r in trusted.collect()}
    n = quality.BUCKETS
    grams = {}
    bucket = {}
    # the hash comes from Spark, the rest from Python
    pairs = sorted({(a, b) for t in texts.values() for w in [[x.decode() for x in words(t)]] for a, b in [*zip(w, w[1:], strict=False), *((x, None) for x in w)]}, key=str)
    p = spark.createDataFrame(pairs, "a string, b string")
    h = F.when(F.col("b").isNull(), F.pmod(F.xxhash64("a"), F.lit(n))).otherwise(F.pmod(F.xxhash64("a", "b"), F.lit(n)) + n)
    bucket = {(r.a, r.b): r.h for r in p.select("a", "b", h.alias("h")).collect()}
    raw, mine = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        w = [x.decode() for x in words(t)]
        grams[i] = [bucket[x, None] for x in w] + [bucket[x] for x in zip(w, w[1:], strict=False)]
        raw.update(grams[i])
        if i in good:
            mine.update(grams[i])
    share = sum(mine.values()) / sum(raw.values())
    weight = lambda g: np.log((mine[g] + quality.SMOOTHING) / (raw[g] * share + quality.SMOOTHING))
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t)
        expected = float(np.mean([weight(g) for g in grams[i]])) if grams[i] else 0.0
        assert r.score == pytest.approx(expected, abs=1e-9)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_edges(spark, edges, none):
    trusted = spark.createDataFrame([(1,), (None,)], "doc_id long")
    rows = quality.quality(edges, trusted, carry=("size", "id")).collect()
    assert len(rows) == len(EDGES) and rows[0].size == "s" and rows[0].id == 1
    assert sorted(base(x[1]) for x in EDGES) == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert quality.quality(none, trusted).count() == 0 and quality.quality(edges, trusted.limit(0)).count() == len(EDGES)


def test_quality_rejects_the_same_junk_in_a_larger_corpus(spark, monkeypatch):
    rng = random.Random(3)
    # good texts follow sentences that recur, junk strings a few of their words at random
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(40)]
    good = [(i, " ".join(rng.sample(lines, 8))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{rng.randrange(40)}" for _ in range(96))) for i in range(60)]
    other = [(2000 + i, " ".join(f"x{rng.randrange(100_000)}" for _ in range(2000))) for i in range(100)]
    # the other text is trusted as often as the first
    trusted = spark.createDataFrame([(i,) for i, _ in good + [x for x in other if x[0] % 4]], "doc_id long")
    monkeypatch.setattr(quality.counters, "__kwdefaults__", quality.counters.__kwdefaults__ | {"least": 1 << 8})
    out = []
    for rows in (good + junk, good + junk + other):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        out.append({r.doc_id for r in quality.quality(d, trusted).where("doc_id < 2000 and not kept").collect()})
    assert out[0] == out[1] == {i for i, _ in junk}
    assert quality.quality(d, trusted, buckets=(1 << 4, 1 << 4)).where("doc_id < 2000 and not kept").count() < 30


def test_quality_counters_follow_the_input(spark, sf):
    d = docs(spark, sf)
    assert quality.counters(d) == (quality.BUCKETS, quality.BUCKETS)
    every = [x for r in d.collect() for x in words(r.text)]
    n, m = quality.counters(d, least=1, per_counter=4, pairs=2)
    assert n & (n - 1) == m & (m - 1) == 0 and 1.8 <= len(set(every)) / n <= 4.4 and 2 <= m / len(every) ** 0.5 < 4


def test_quality_by_shuffle_equals_by_array(spark, sf, edges, none, monkeypatch):
    for d, trusted in ((docs(spark, sf), quality.trusted_ids(spark, sf)), (edges, spark.createDataFrame([(1,)], "doc_id long")), (none, spark.createDataFrame([(1,)], "doc_id long"))):
        expected = sorted(((r.doc_id, r.kept, r.base_failed, round(r.score, 9)) for r in quality.quality(d, trusted).collect()), key=str)
        for hot in (1 << 16, 50):
            with monkeypatch.context() as m:
                m.setattr(quality, "BROADCAST_COUNTERS", 0)
                m.setattr(quality, "HOT", hot)
                got = quality.quality(d, trusted, carry=("text",)).collect()
            assert sorted(((r.doc_id, r.kept, r.base_failed, round(r.score, 9)) for r in got), key=str) == expected


# 4


def groups(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    label = {k: k for k in range(len(sets))}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least.get(find(k), i)) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("percent", "local", "hot"), [(85, 256, None), (60, 2, 3), (40, 3, 0)])
def test_jaccard_equals_brute_force(spark, percent, local, hot):
    random.seed(percent)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = [random.choice(vocabulary) for _ in range(random.randrange(1, 60))]
        for _ in range(random.choice([1, 1, 3])):
            v = [x if random.random() > 0.02 else random.choice(vocabulary) for x in w]
            rows.append((len(rows), " ".join(v).upper() if i % 2 else "  ".join(v)))
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=percent, local=local, centres=local, hot=hot).collect()
    assert sorted(map(tuple, out), key=str) == groups(rows, 3, percent)


@pytest.mark.parametrize(("edits", "percent"), [(2, 85), (4, 70), (9, 85)])
def test_jaccard_of_many_near_copies(spark, edits, percent):
    random.seed(edits)
    origin = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(origin)
        for _ in range(random.randrange(edits + 1)):
            w[random.randrange(60)] = f"x{random.randrange(5)}"
        rows.append((i, " ".join(w)))
    rows += [(i + 300, t + " tail of other words" * (i % 2)) for i, t in rows[::3]]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=percent, local=40, centres=5).collect()
    assert sorted(map(tuple, out), key=str) == groups(rows, 3, percent)


def test_jaccard_edges(spark, edges, none):
    out = jaccard.jaccard_components(edges, width=4, percent=85).collect()
    assert sorted(map(tuple, out), key=str) == groups([(r[0], r[1]) for r in EDGES], 4, 85)
    assert jaccard.jaccard_components(none).count() == 0


def test_histogram_bound_is_safe():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(1, 60))) for _ in range(2))
        h = np.stack([np.bincount(x % 8, minlength=8) for x in (a, b)])
        i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * i >= 85 * u:
            assert jaccard.possible(h, 85).all()


# 5


def test_water_fill():
    t = mixing.water_fill({"a": 100, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 450)
    assert t == {"a": 200.0, "c": pytest.approx(250 * 2 / 3), "b": pytest.approx(250 / 3)}
    assert mixing.water_fill({}, {}, 0) == {}


def test_flow_is_minimal():
    flow = mixing.min_cost_flow({("a", "b"): 10, ("a",): 5, ("b",): 2}, {"a": 10, "b": 8})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 10 and sum(v for (_, s), v in flow.items() if s == "b") == 8
    # 18 words are asked for, 17 are there once: only one word is a repetition
    sent = collections.Counter()
    for (p, _), v in flow.items():
        sent[p] += v
    assert sum(max(0, v - {("a", "b"): 10, ("a",): 5, ("b",): 2}[p]) for p, v in sent.items()) == 1


def test_mix_of_overlapping_sources(spark):
    d = spark.createDataFrame([(i, ["a", "b"] if i % 3 else ["a"], 1 + i % 7) for i in range(300)], "doc_id long, sources array<string>, size long")
    a, b = (sorted(map(repr, mixing.mix(x, budget=1.2).collect())) for x in (d, d.repartition(5)))
    assert a == b
    rows = mixing.mix(d, budget=1.2).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.2 * sum(r.size for r in rows)) <= 14


def test_mix_of_very_many_sources_equals_the_flow(spark, monkeypatch):
    random.seed(5)
    rows = [(i, f"text {'w ' * random.randrange(9)}", "en", random.choice([None, "hot", "hot", *(f"s{k}" for k in range(40))]), 1) for i in range(900)]
    d = spark.createDataFrame([*rows, *EDGES], DOCS)
    key = lambda r: str(tuple(r))
    flow = sorted(mixing.mix_documents(d).collect(), key=key)
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    monkeypatch.setattr(places, "HOT_ROWS", 50)
    spread = sorted(mixing.mix_documents(d).collect(), key=key)
    assert len(flow) == len(spread)
    for a, b in zip(flow, spread, strict=True):
        assert (a.doc_id, a.sources, a.size, a.source_size, a.taken) == (b.doc_id, b.sources, b.size, b.source_size, b.taken) and a.target == pytest.approx(b.target)


def test_mix_edges(spark, edges, none):
    rows = mixing.mix_documents(edges).collect()
    assert len(rows) == len(EDGES) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix_documents(none).count() == 0


# 6


@pytest.mark.parametrize("most_chunks", [1 << 14, 3, 1])
def test_topk_equals_brute_force(spark, most_chunks):
    random.seed(6)
    rows = [(i, [random.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)], "x") for i in range(300)]
    rows += [(1000, None, ""), (1001, [1.0, None, 0.0, 0.0], ""), (1002, [float("nan")] * 4, ""), (1003, [float("inf"), 0.0, 0.0, 0.0], ""), (None, [1.0] * 4, ""), (7, [0.9, 0.9, 0.9, 0.9], "twice")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk.top_k(d, d.where("vec_id % 50 = 0"), annulus=16, chunk=32, query_slice=3, most_chunks=most_chunks, pivots=9).orderBy("query_id", "rank").collect()]
    v = [(i, np.floor(256 * np.array(x, float))) for i, x, _ in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    expected = []
    for q, x in v:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in v if i != q)[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(expected)


def test_topk_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(d).collect())) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d, d.limit(0)).count() == 0


def test_topk_of_many_equal_vectors_and_repeated_queries(spark):
    # one vector on a third of all rows: one pivot's annuli hold them all
    rows = [(i, [0.5, 0.5] if i % 3 else [float(i % 7) / 7, -0.25], "clash") for i in range(240)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance string").withColumns({"chunk": F.lit(1), "kth": F.lit("x")})
    asked = d.where("vec_id % 50 = 0")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(d, asked.unionByName(asked), annulus=8, chunk=16, query_slice=2).collect())
    v = {i: np.floor(256 * np.array(x)) for i, x, _ in rows}
    expected = [(q, k + 1, i) for q in v if q % 50 == 0 for k, (_, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5])]
    assert got == sorted(expected)


# 7


def cut_words(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def test_substring_equals_brute_force(spark, edges, none):
    random.seed(7)
    rows = [(i, " ".join(random.choice(["a", "b"]) for _ in range(random.randrange(0, 40)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring.remove_repeats(d, width=6).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str) == cut_words(rows, 6)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)
    out = substring.remove_repeats(edges, width=5, carry=("size",)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str) == cut_words([(r[0], r[1]) for r in EDGES], 5)
    assert {r.size for r in out} == {"s"} and substring.remove_repeats(none).count() == 0


# 8


def test_suffix_array_is_sorted():
    rng = random.Random(8)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 50))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def cut_bytes(rows, length):
    seen, out = set(), []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), kept))
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_equals_brute_force(spark, hot):
    random.seed(8)
    passage = "".join(random.choice("abc ") for _ in range(80))
    rows = [(i, "".join(random.choice("ab") for _ in range(random.randrange(0, 90))) + (passage[: random.randrange(80)] if i % 2 else "") + "é" * (i % 3)) for i in range(50)]
    rows += [(90, None), (91, ""), (92, "xyz" * 60), (93, rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix.remove_repeated_bytes(d, length=20, gram=6, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == cut_bytes(rows, 20)


def test_suffix_edges(spark, edges, none):
    out = suffix.remove_repeated_bytes(edges).collect()
    assert len(out) == len(EDGES) and suffix.remove_repeated_bytes(none).count() == 0
    own = {r.doc_id: r for r in out}
    assert own[9].n_removed == own[9].n_bytes and own[8].n_removed > 0
    assert own[None].n_removed == 0


def test_suffix_query_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in docs(spark, sf).collect()]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op8_suffix(spark, sf).collect())
    assert got == [(i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in cut_bytes(rows, 100)]


# 9


def whole_pieces(rows, texts, encode):
    """Asserts that pieces cover the ids of (doc_id, text) once, with the right checksums, and fill sequences without gaps."""
    ids = collections.defaultdict(list)
    for i, text in texts:
        ids[i].append([*encode(text or "").tolist(), 1])
    pieces, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        by[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in ids.items():
        covered = collections.Counter()
        for s, n, crc, t in pieces[i]:
            fit = [x for x in own if len(x) == t and zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) == crc]
            assert fit and n > 0 and s + n <= t
            covered.update(range(s, s + n))
        assert covered == collections.Counter(k for x in own for k in range(len(x)))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_packing_is_whole_and_gapless(spark, sf, edges, none):
    path, ranks = packing.default_paths()
    slow = packing.encoder(path, None)
    for d in (docs(spark, sf), edges):
        rows = packing.pack_documents(d, keep_ids=True).collect()
        whole_pieces(rows, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], slow)
        assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(none).count() == 0
    key = lambda r: str(tuple(r))
    a, b = (sorted(packing.pack_documents(x).collect(), key=key) for x in (docs(spark, sf), docs(spark, sf).repartition(7)))
    assert a == b


def test_fast_tokens_equal_tokenizers():
    path, ranks = packing.default_paths()
    fast, slow = packing.encoder(path, ranks), packing.encoder(path, None)
    for t in ["", " ", "  two  blanks\n\n\tand more ", "it's we'll I'M", "naïve façade – “quotes” 中文 🎉🎉", "123 4567abc!!??", "<|endoftext|> plain", "a" * 3000, " " * 5000, "\r\n \r\n", "é" * 700, "x y z\x1c\x1d"]:
        assert fast(t).tolist() == slow(t).tolist(), t[:30]


def test_added_tokens_are_the_contracts(spark):
    from tokenizers import Tokenizer

    path, ranks = packing.default_paths()
    contract = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext| >", "plain"]
    for t in texts:
        ids = contract.encode(t, add_special_tokens=False).ids
        assert packing.encoder(path, ranks)(t).tolist() == packing.encoder(path, None)(t).tolist() == ids
    assert 50256 in contract.encode(texts[0], add_special_tokens=False).ids
    got = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: zlib.crc32(np.array([*contract.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in enumerate(texts)}


def naive_sum_of_squares(sizes, capacity):
    """Levels of the open bins after each item, by trying every placement and summing all squares."""
    count, placed = collections.Counter(), []
    for s in sizes:
        best = None
        for level in sorted((h for h in {0, *count} if h + s <= capacity), reverse=True):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + s < capacity:
                c[level + s] += 1
            cost = sum(n * n for n in c.values())
            if best is None or cost < best[0]:
                best = (cost, level, +c)
        placed.append(best[1])
        count = best[2]
    return placed


def test_sum_of_squares_equals_naive_placement():
    rng = np.random.default_rng(9)
    for capacity in (12, 40):
        sizes = rng.integers(1, capacity, 400)
        where, offset, bins = packing.sum_of_squares(sizes, capacity)
        assert offset.tolist() == naive_sum_of_squares(sizes.tolist(), capacity)
        fill = np.bincount(where, weights=sizes, minlength=bins)
        assert fill.max() <= capacity and len(fill) == bins


@pytest.mark.parametrize(("capacity", "grain"), [(2048, 64), (64, 8), (64, 64)])
def test_dissolved_windows_are_whole_and_full(capacity, grain):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, capacity, 3000)
    where, offset, bins = packing.sum_of_squares(sizes, capacity)
    parts = packing.dissolved(sizes, where, offset, bins, capacity, grain)
    by_item, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for i, first, n, b, at in parts:
        by_item[i].append((first, n))
        by_bin[b].append((at, n))
        assert n > 0 and first % grain == 0
    for own, size in [(by_item[i], s) for i, s in enumerate(sizes.tolist())] + [(v, None) for v in by_bin.values()]:
        at = 0
        for first, n in sorted(own):
            assert first == at
            at += n
        assert at == size if size is not None else at <= capacity
    if grain < capacity:
        assert len(by_bin) * capacity <= 1.02 * sizes.sum() + capacity
        assert sum(sum(n for _, n in v) <= capacity - grain for v in by_bin.values()) <= 1


def test_checksums_of_cut_parts():
    raw = np.random.default_rng(2).integers(0, 50_000, 1500).astype("<u4").tobytes()
    whole, marks = packing.checksums(raw, 64, 2048)
    assert whole == zlib.crc32(raw) and len(marks) == 1500 // 64
    for a, b in ((0, 64), (64, 640), (640, 1500), (0, 1500), (1472, 1500)):
        upto = whole if b == 1500 else marks[b // 64 - 1]
        assert packing.crc_after(upto, marks[a // 64 - 1] if a else 0, b - a) == zlib.crc32(raw[4 * a : 4 * b])


def test_packing_pads_little(spark):
    d = docs(spark, "/root/testdata/sf0.01")
    rows = packing.pack_documents(d).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(rows) * 2048 <= 1.01 * sum(r.n for r in rows)


# 10


def article(page):
    a = page.split("<article>")[1]
    a = a.split("</article>")[0] if "</article>" in a else a.split("<footer>")[0]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", a)]
    return "\n".join(b for b in blocks if b)


def test_pages_keep_articles(spark):
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r.text for r in pages.extract_pages(p).collect()}
    assert out == {r.page_id: article(r.html) for r in p.collect()}


def test_pages_remove_what_recurs(spark):
    body = lambda i: f"<html><body><div><a href=/>Home</a> Contact us today</div><div>Story {i} has text {i * i}.</div><div><p>All rights</p><p>reserved</p></div></body>"
    rows = [(i, f"http://U@Site.test:80/{i}", body(i)) for i in range(12)] + [(50, "http://other.test/", body(1)), (51, None, body(2)), (52, "nonsense", None), (53, "http://site.test", "")]
    out = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Story {i} has text {i * i}." for i in range(12))
    assert "Home" in out[50] and "Home" in out[51] and out[52] == out[53] == ""


@pytest.mark.parametrize("bound", [None, 0])
def test_menus_of_sections_go_on_a_hot_host(spark, monkeypatch, bound):
    # 20 sections of 12 pages each: a menu is on 5 % of the host's pages; the list in the article too
    menu = lambda s: f"<div><ul><li><a href=/{s}/a>Section {s} first</a><li>Section {s} second</ul></div>"
    body = lambda i: f"<body>{menu(i % 20)}<div>Story {i} has text {i * i}.</div></body>"
    inner = lambda i: f"<body><article><h1>Title {i}</h1><p>Text {i}.</p>{menu(i % 20)}</article></body>"
    copy = "<body><article><h1>Copied</h1><p>Same</p><ul><li>own list</ul></article></body>"
    rows = [(i, "http://hot.test/", body(i)) for i in range(240)] + [(1000 + i, "http://hot.test/", inner(i)) for i in range(240)] + [(2000 + i, "http://hot.test/", copy) for i in range(30)]
    if bound is not None:
        monkeypatch.setattr(pages, "HOST_HASHES", bound)
        monkeypatch.setattr(pages, "HOT", 12)
    out = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"Story {i} has text {i * i}." and out[1000 + i] == f"Title {i}\nText {i}." for i in range(240))
    assert all(out[2000 + i] == "Copied\nSame\nown list" for i in range(30))


def test_counts_alone_find_the_articles(spark):
    # on hosts of 5 pages or more nothing is left for the markup to decide
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = p.collect()
    hosts = collections.Counter(pages.host_of(r.url) for r in rows)
    alone = {r.page_id: r.text for r in pages.extract_pages(p, markup=False).collect()}
    large = [r for r in rows if hosts[pages.host_of(r.url)] >= pages.MIN_PAGES]
    assert len(large) > 100 and all(alone[r.page_id] == article(r.html) != pages.extract(r.html, markup=False) for r in large)


def test_unnamed_menus_go_without_article_tags(spark):
    # no tag and no class says what is what: only menus have a shape that recurs
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", "(</?)(nav|article|footer)", "$1div"), ' class="ad"', "")
    rows = p.withColumn("html", plain).collect()
    hosts = collections.Counter(pages.host_of(r.url) for r in rows)
    got = {r.page_id: r.text for r in pages.extract_pages(p.withColumn("html", plain)).collect()}
    for r in rows:
        menu = [html.unescape(x) for x in re.findall("<li><a[^>]*>([^<]*)", r.html)]
        rest = pages.extract(r.html).split("\n")
        cut = rest[len([x for x in menu if x.split()]) :] if hosts[pages.host_of(r.url)] >= pages.MIN_PAGES else rest
        assert got[r.page_id].split("\n") == cut


def test_pages_equal_naive_counts(spark):
    # every subtree's text by a plain reading, counted in a dictionary
    random.seed(4)
    blocks = [f"<div><p>Block {k} of the site</p></div>" for k in range(12)]
    rows = [(i, f"http://h{i % 2}.test/", "<body>" + "".join(random.sample(blocks, 4)) + f"<div>Own text of page {i}</div></body>") for i in range(60)]
    count = collections.Counter()
    for i, _, page in rows:
        count.update((i % 2, x) for x in set(re.findall("Block \\d+ of the site", page)))
    out = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), min_pages=11, min_articles=11).collect()}
    for i, _, page in rows:
        kept = [x for x in re.findall("Block \\d+ of the site", page) if count[i % 2, x] < 11]
        assert out[i] == "\n".join([*kept, f"Own text of page {i}"])


def test_copied_articles_stay(spark):
    page = "<body><nav>n</nav><article><h1>T</h1><p>Same words</p><ul><li>x</ul></article><footer>f</footer>"
    d = spark.createDataFrame([(i, "http://h.test/", page) for i in range(9)], "page_id long, url string, html string").withColumns({"host": F.lit("h"), "templates": F.lit(0)})
    assert {r.text.split("\n")[1] for r in pages.extract_pages(d).collect()} == {"Same words"}
    assert pages.extract_pages(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="cookie-notice">x</div><p>a &amp; b<p>c<ul><li>1<li>2</ul>', "a & b\nc\n1\n2"),
        ("<main><h1>T</h1><p>x<br>y</p><section class=comments><article>c</article></section></main>", "T\nx y"),
        ("<p>3 < 4 and\n\n 5 > 2</p>", "3 < 4 and 5 > 2"),
        ('<script>var t="</p><p>no";</script><p>yes', "yes"),
        ("<article><form>f</form><p>p</p><aside>s</aside><div class='ad'>ad</div><table><tr><td>1<td>2</table></article>", "p\n1\n2"),
        ("<!-- <p>no</p> --><p title='a>b'>t&eacute;xt &#8364;&nbsp;</p>", "téxt €"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<article><p>open", "open"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"),
        ('<article><p class="share-price">Price was 3</p><div class="alert-level">text</div></article>', "Price was 3\ntext"),
        ("<article><p>one that is far longer than the other</p></article><article><p>b</p></article>", "one that is far longer than the other\nb"),
        ('<article>x<article class="comment">c</article></article><article class="comment-list">d</article>', "x"),
        ('<div class="widget"><article><div class="share-buttons">s</div><p>kept</p></article></div>', "kept"),
    ],
)
def test_markup(page, text):
    assert pages.extract(page) == text


# helpers


def test_words_are_split_at_ascii_space_only(spark):
    t = "a b c\x0bd e\n\nf"
    assert words(t) == [x.encode() for x in ("a b", "c", "d e", "f")]
    starts, ends, hashes = common.word_hashes(np.frombuffer(t.encode(), np.uint8))
    assert [t.encode()[a:b] for a, b in zip(starts, ends, strict=True)] == words(t) and len(set(hashes.tolist())) == 4
    assert spark.createDataFrame([(t,)], "t string").select(quality.words_of(F.col("t"))).first()[0] == [w.decode() for w in words(t)]


def test_nothing_is_dealt_to_nobody():
    none = np.zeros(0, np.int64)
    assert common.dealt(none.astype(np.int32), none, runs=none, names=("part", "x", "heads", "lengths")).num_rows == 0


def test_unique_texts_lose_nothing(spark):
    d = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(4)], "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring.remove_repeats(d).collect())
    assert all(r.n_removed == 0 for r in suffix.remove_repeated_bytes(d).collect())


def test_buckets_agree(spark):
    ids = [0, 1, -5, 2**40 + 3, 2**62, -(2**63)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(common.id_bucket_column(F.col("i"), 17)).collect()]
    assert got == common.id_bucket(np.array(ids, np.int64), 17).tolist()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<main><h1>Title</h1><p>Lead</p><article><p>Body text</p></article><p>After</p></main>", "Title\nLead\nBody text\nAfter"),
        ("<p>Site</p><main><p>Lead</p><article><p>One</p></article></main><article><p>Two</p></article>", "One\nTwo"),
        ('<article><div class="header"><h2>Section</h2></div><p>x</p></article>', "Section\nx"),
        ('<article><div class="search">Search parties went out</div><p class="notice">He gave notice.</p><p>x</p></article>', "Search parties went out\nHe gave notice.\nx"),
        *[(f'<article><p>x</p><div class="{c}">bad</div></article>', "x") for c in "ad-slot adsbygoogle commentlist user-comments comment-thread share-tools related-stories relatedStories cookieNotice newsletter-signup".split()],
        ('<article><p>x</p><p class="advertisement">bad</p><p class="cookie-notice">bad</p><h2 class="advert">Adverts of the past</h2></article>', "x\nAdverts of the past"),
        ('<div class="header">Site</div><div class="search">Find</div><div class="share-price"><p>Up</p></div>', "Up"),
    ],
)
def test_names_in_and_around_articles(page, text):
    assert pages.extract(page) == text


def test_flow_of_very_many_patterns():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(2000)]

    def checked(capacities, quotas, repeats):
        flow, sent, got = mixing.min_cost_flow(capacities, quotas, repeats), collections.Counter(), collections.Counter()
        for (p, s), v in flow.items():
            assert s in p and v > 0
            sent[p] += v
            got[s] += v
        assert all(got[s] <= q for s, q in quotas.items()) and all(sent[p] <= repeats * w for p, w in capacities.items())
        return sum(sent.values()), sum(sum(max(0, v - k * capacities[p]) for k in range(1, repeats)) for p, v in sent.items())

    def plain(capacities, quotas, repeats):
        # the most that any choice of first copies, then of later ones, can send: by all cuts
        def most(k):
            best = float("inf")
            for n in range(len(quotas) + 1):
                for cut in itertools.combinations(quotas, n):
                    best = min(best, sum(quotas[s] for s in cut) + sum(k * w for p, w in capacities.items() if set(p) - set(cut)))
            return best

        upto = [most(k) for k in range(repeats + 1)]
        return upto[-1], sum((k - 1) * (upto[k] - upto[k - 1]) for k in range(2, repeats + 1))

    for _ in range(60):
        some = names[: rng.randrange(1, 5)]
        capacities = {tuple(sorted(rng.sample(some, rng.randrange(1, len(some) + 1)))): rng.randrange(20) for _ in range(rng.randrange(1, 7))}
        quotas, repeats = {s: rng.randrange(30) for s in some}, rng.choice([1, 2, 3])
        assert checked(capacities, quotas, repeats) == plain(capacities, quotas, repeats)
    start = time.perf_counter()
    capacities = {tuple(sorted(rng.sample(names, rng.choice([1, 2, 3])))): rng.randrange(1, 1000) for _ in range(20_000)}
    total, _ = checked(capacities, {s: rng.randrange(9000) for s in names}, 2)
    assert total > 0 and time.perf_counter() - start < 60


def test_rarity_in_two_levels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    tables = rng.integers(0, 5, (70, jaccard.SLICES, 4)).astype(np.int32)
    monkeypatch.setattr(jaccard, "CELLS", 4 * jaccard.SLICES)
    rows = [(k, t[k].tobytes()) for t in tables for k in range(jaccard.SLICES)] + [(None, None)]
    d = spark.createDataFrame(rows, "slice int, counts binary").repartition(9)
    np.testing.assert_array_equal(jaccard.rarity(d), tables.sum(axis=0).ravel())
