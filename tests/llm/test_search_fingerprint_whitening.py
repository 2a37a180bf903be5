import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import test_operators as t
from tests.llm.test_operators import edges, none  # noqa: F401
from weir.llm import fingerprints, lexical, topk, whitening

# 6


def scores_of(rows, asked, k=topk.K, scale=256):
    x = [(i, np.floor(scale * np.array(v, np.float64))) for i, v in rows]
    out = set()
    for q, v in {i: v for i, v in reversed(x) if i in asked}.items():
        best = sorted((-int(v @ w), i) for i, w in x if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_search_prunes_clusters(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 6000)] + rng.normal(0, 0.05, (6000, 24))).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.choice([0.5, 1.0, 2.0], (6000, 1)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    asked = d.where("vec_id % 50 = 0")
    counts: list = []
    got = {tuple(r) for r in topk.top_k(d, asked, chunk=512, query_slice=16, compared=counts).collect()}
    assert got == scores_of(rows, set(range(0, 6000, 50)))
    # fewer than half of all pairs are compared
    assert len(counts) == 2 and 0 < sum(counts) < 0.5 * 120 * 6000


@pytest.mark.parametrize(("pivots", "annulus", "part", "query_slice", "most_chunks"), [(64, 64, 8192, 512, 1 << 14), (3, 2, 5, 2, 2), (8, 4, 7, 1, 100)])
def test_search_equals_all_pairs(spark, pivots, annulus, part, query_slice, most_chunks):
    rng = np.random.default_rng(pivots)
    x = rng.normal(size=(90, 5)).round(2)
    x[10:40] = x[3]  # a third are one vector
    x[41] = 0
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5, x[7].tolist())]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [1.0] * 4), (105, []), (None, [1.0] * 5)]
    d = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *odd]], VECTORS).withColumns({"chunk": F.lit("clash"), "rank": F.lit(1)}).repartition(3)
    exact = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got = [tuple(r) for r in topk.top_k(d, d.where("vec_id % 10 = 0"), pivots=pivots, annulus=annulus, chunk=part, query_slice=query_slice, most_chunks=most_chunks).collect()]
    assert len(got) == len(set(got)) and set(got) == scores_of(exact, set(range(0, 90, 10)))


def test_search_of_little(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [0.5, 0.5], 0)], VECTORS)
    assert {tuple(r) for r in topk.top_k(d).collect()} == {(1, 1, 2, 3 * 128 * 256), (2, 1, 1, 3 * 128 * 256)}
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d.where("vec_id = 1")).count() == 0


# 11


def shingle_set(text, words=5):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", text or "") if x]
    some = [w[i : i + words] for i in range(len(w) - words + 1)] or ([w] if w else [])

    def chained(s):
        h = 42
        for x in s:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        return h - (1 << 64) if h >> 63 else h

    return {chained(s) for s in some}


def sketch_of(text, k=fingerprints.K):
    return sorted(shingle_set(text))[:k]


def likeness(a, b, k=fingerprints.K):
    u = sorted(set(a) | set(b))[:k]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def digits(s):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in s)


def plain_fingerprints(rows):
    signed = lambda x: f"{x:X}" if x else "0"
    key = lambda r: (r[0] is not None, r[0] or 0, (f"{r[0]}:" if r[0] is not None else "") + signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))
    order = sorted({key(r): (r[0], r[1] or "") for r in rows}.items())
    after = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    out = []
    for r in rows:
        text, (next_id, following) = r[1] or "", after[key(r)]
        q = len(text) // 4
        new = text[: len(text) - q] + following[:q]
        a, b, c = sketch_of(text), sketch_of(new), sketch_of(following)
        out.append((r[0], len(text), hashlib.sha256(new.encode()).hexdigest(), digits(a), digits(b), round(likeness(a, b), 9), round(likeness(a, c), 9), next_id))
    return collections.Counter(out)


def figures(df):
    return collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.next_id) for r in df.collect())


def test_fingerprints_equal_plain(spark, sf):
    rows = [(r.doc_id, r.text) for r in t.docs(spark, sf).collect()]
    assert figures(fingerprints.op11_fingerprints(spark, sf)) == plain_fingerprints(rows)


def test_fingerprints_edges(spark, edges, none):  # noqa: F811
    assert figures(fingerprints.fingerprints(edges.withColumns({"_text": F.lit(1), "_key": F.lit(2), "fingerprint": F.lit("x")}))) == plain_fingerprints([(r[0], r[1]) for r in t.EDGES])
    assert fingerprints.fingerprints(none).count() == 0
    alone = fingerprints.fingerprints(edges.where("doc_id = 7")).first()
    assert (alone.next_id, alone.near_next, alone.n_chars) == (7, 1.0, 1)


def test_sketches_merge_and_estimate(spark):
    text = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    parts = [("x", text(0, 900)), ("x", text(600, 3000)), ("x", text(0, 900)), ("y", text(2000, 4000)), ("small", text(0, 9)), ("none", ""), ("none", None), (None, text(0, 50))]
    d = spark.createDataFrame(parts, "g string, text string").repartition(4).withColumn("sketch", fingerprints.sketch(F.col("text")))
    got = {r.g: r.sketch for r in fingerprints.merged(d, "g").collect()}
    assert got["none"] == [] and got[None] == sketch_of(text(0, 50))
    assert got["x"] == sorted(shingle_set(text(0, 900)) | shingle_set(text(600, 3000)))[: fingerprints.K]
    both = spark.createDataFrame([(got["x"], got["y"], got["small"])], "x array<long>, y array<long>, s array<long>")
    r = both.select(
        fingerprints.resemblance(F.col("x"), F.col("y")).alias("j"), fingerprints.containment(F.col("y"), F.col("x")).alias("c"), fingerprints.containment(F.col("s"), F.col("x")).alias("small"),
        fingerprints.distinct_shingles(F.col("x")).alias("n"), fingerprints.distinct_shingles(F.col("s")).alias("five"), fingerprints.from_fingerprint(fingerprints.fingerprint(F.col("x"))).alias("back"),
        fingerprints.from_fingerprint(F.lit("")).alias("nothing"),
    ).first()
    assert r.back == got["x"] and r.nothing == [] and r.five == 5.0
    assert r.j == pytest.approx(0.25, abs=0.12) and r.c == pytest.approx(0.5, abs=0.2) and r.n == pytest.approx(2996, rel=0.25)
    assert 0 <= r.small <= 1


# 12


def plain_ranking(documents, items, k=lexical.K):
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (s or "").translate({c: c + 32 for c in range(65, 91)}))
    d = [(i, collections.Counter(terms(x))) for i, x in documents if i is not None]
    n, length = sum(bool(c) for _, c in d), sum(sum(c.values()) for _, c in d)
    df = collections.Counter(w for _, c in d for w in c)
    asked: dict = {}
    for i, x in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(x))
    out = []
    for i, q in asked.items():
        scored = []
        for doc, c in d:
            size = sum(c.values())
            m = 100 - 50 + (50 * size * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in q if w in c)
            if s > 0:
                scored.append((-s, doc))
        out += [(i, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize(("k", "shard", "asked"), [(50, 1 << 24, 1 << 20), (3, 20_000, 1 << 20), (2, 3000, 500)])
def test_search_equals_plain_ranking(spark, sf, k, shard, asked):
    d, items = t.docs(spark, sf).limit(150), spark.read.parquet(f"{sf}/benchmark.parquet").limit(12)
    documents, asks = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in items.collect()]
    got = lexical.lexical_search(spark.createDataFrame(documents, "doc_id long, text string").repartition(3), spark.createDataFrame(asks, "item_id long, text string"), k=k, shard=shard, asked=asked)
    assert collections.Counter(map(tuple, got.collect())) == plain_ranking(documents, asks, k)


def test_search_edges(spark, edges, none):  # noqa: F811
    items = [(1, "ONE six, Apfel Öl"), (1, "x"), (2, ""), (3, None), (None, "one"), (4, "öl"), (5, "one one two"), (5, "one one two"), (6, "nowhere")]
    asks = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = lexical.lexical_search(edges.withColumn("item_id", F.lit(0)), asks)
    assert collections.Counter(map(tuple, got.collect())) == plain_ranking([(r[0], r[1]) for r in t.EDGES], items)
    assert lexical.lexical_search(none, asks).count() == 0 and lexical.lexical_search(edges, asks.limit(0)).count() == 0


def test_threshold_search_stops_early():
    # one rare term with great impacts: the common term's long list is not read to its end
    texts = [b"common " * 3 + (b"rare " * (5 if i < 40 else 0)) + b"f%d" % i for i in range(5000)]
    vocabulary = np.unique(np.concatenate([lexical.term_hashes(b"common rare")]))
    lengths, terms, places, counts = lexical.postings(texts, vocabulary)
    row = {"ids": np.arange(5000).tobytes(), "lengths": lengths.astype(np.int64).tobytes(), "terms": terms.astype(np.int32).tobytes(), "places": places.astype(np.uint16).tobytes(), "counts": counts.astype(np.int32).tobytes()}
    df = np.bincount(terms, minlength=2)
    shard = lexical.Shard(row, np.array([lexical.term_weight(5000, int(x)) for x in df]), 5000, int(lengths.sum()))
    best, score = shard.search(np.arange(2), 10, 0)
    assert best.tolist() == list(range(10)) and len(set(score.tolist())) == 1 and shard.read < 500
    before = shard.read
    assert len(shard.search(np.arange(2), 10, int(score[0]) + 1)[0]) == 0 and shard.read - before < 500


# 13


def plain_whitening(vectors, components=4):
    x = np.floor(256 * np.array(vectors, np.float64)) + 0.0
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return x, fit, e[:components], u[:, :components], np.trace(v), (x - fit.mean(axis=0)) @ u[:, :components] / np.sqrt(e[:components])


def check_whitening(rows, ids, vectors, components=4):
    x, fit, e, _, trace, white = plain_whitening(vectors, components)
    n, s = len(fit), fit.sum(axis=0).astype(np.int64)
    assert len(rows) == len(ids) * len(e)
    by = {(r.vec_id, r.component): r for r in rows}
    got = np.array([[by[i, c + 1].whitened for c in range(len(e))] for i in ids])
    sign = np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got * sign, white, atol=1e-6)
    far = {i: int(((n * v.astype(np.int64) - s) ** 2).sum()) for i, v in zip(ids, x, strict=True)}
    for r in rows:
        assert r.n == n and r.deviation == far[r.vec_id] and r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9) and r.identity_error < 1e-9 and r.residual <= 1e-11


def test_whitening_equals_numpy(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_whitening(whitening.op13_whitening(spark, sf).collect(), [r.vec_id for r in d], [r.embedding for r in d])


@pytest.mark.parametrize("decay", [0.5, 0.97])
def test_whitening_by_thin_blocks(spark, decay):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 60)) * decay ** np.arange(60) * 3) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    x[100:400] = x[0]  # copies weigh once
    d = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    ints = whitening.integers(d)
    model = whitening.Whitening().fit(ints)
    check_whitening(model.transform(ints).collect(), list(range(700)), x.tolist())
    # a falling spectrum needs no wide block, a flat one is widened instead of waited for
    assert model.passes <= 25


def test_whitening_edges(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (9, 3)) / 2.0
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    odd = [(20, None, 0), (21, [1.0, None, 2.0], 0), (22, [float("nan"), 0.0, 0.0], 0), (23, [float("inf"), 0.0, 0.0], 0), (24, [1.0, 2.0], 0), (25, [], 0), (26, [1e300, 0.0, 0.0], 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit("clash"), "component": F.lit(0), "n": F.lit(0)})
    check_whitening(whitening.whiten(d).collect(), list(range(9)), x.tolist(), 3)
    # a row without an id has its result, equal vectors have none, nor has an empty table
    assert sorted({str(r.vec_id) for r in whitening.whiten(d.where("vec_id < 9").withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))).collect()}) == sorted([*map(str, range(1, 9)), "None"])
    assert whitening.whiten(d.where("vec_id = 1").union(d.where("vec_id = 1"))).count() == 0 and whitening.whiten(d.limit(0)).count() == 0
    # two different vectors have one component; deviations beyond 64 bits are null
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(two).collect()} == {1}
    large = spark.createDataFrame([(1, [0.0]), (2, [2.0**40])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(large).collect()} == {None}
