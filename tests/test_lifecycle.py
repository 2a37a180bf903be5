import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.functions import text
from weir.operators import corpus, metrics, places, policy, reports, similarity


def test_overlap_equals_brute_force(spark):
    random.seed(3)
    base = ["".join(random.choice("abcd") for _ in range(random.randrange(5, 40))) for _ in range(30)]
    rows = [(i, random.choice(base)[: random.randrange(8, 40)] + random.choice(["", "x", "yz"])) for i in range(150)] + [(900, None), (901, "")]
    grams = lambda t: {t[i : i + 3] for i in range(max(len(t) - 2, 1))}
    first = {}
    for i, t in rows:
        if t and len(t) >= 10:
            first.setdefault(t, i)
    items = sorted((i, grams(t)) for t, i in first.items())
    expected = {(a, b): len(x & y) / len(x | y) for a, x in items for b, y in items if a < b and len(x & y) / len(x | y) >= 0.7}
    pairs = similarity.overlap_pairs(spark.createDataFrame(rows, "id long, t string"), id_col="id", text="t", min_length=10)
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got) and got
    s = similarity.saturation(pairs).first()
    assert s.pairs == len(got) and s.most_neighbours == max(sum(i in k for k in got) for i, _ in items)
    nothing = similarity.saturation(pairs.limit(0)).first()
    assert (nothing.pairs, nothing.texts, nothing.most_neighbours) == (0, 0, None)


def test_text_helpers(spark):
    d = spark.createDataFrame([("10.2.3.4", "rf_v9", "", "q", "/p"), ("::1", "none", "b", "q", "/p"), (None, None, None, None, None)], "ip string, v string, body string, query string, path string")
    rows = d.select(text.subnet(F.col("ip")), text.next_version(F.col("v")), similarity.raw_text()).collect()
    assert [tuple(r) for r in rows] == [("10.2.3.0/24", "rf_v10", "q"), ("::1", None, "b"), (None, None, "")]


def test_numbers_follow_the_order(spark):
    d = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows = places.numbered(d, "k", "id").orderBy("request_id").collect()
    assert [r.request_id for r in rows] == list(range(1, 1001)) and [r.k for r in rows] == sorted(r.k for r in rows)


def test_replay_gate(spark):
    fixture = spark.createDataFrame([(1, "sqli"), (2, "xss"), (3, "benign"), (4, "cmdi")], "request_id long, expected string")
    rows = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "request_id long, was boolean, now boolean")
    assert tuple(reports.replay_gate(fixture, rows).first()) == (4, 3, 1, 2, pytest.approx(2 / 3), False)
    assert tuple(reports.replay_gate(fixture, rows.where("request_id <> 2")).first()) == (4, 2, 0, 2, 1.0, True)
    assert tuple(reports.replay_gate(fixture.limit(0), rows.limit(0)).first()) == (0, 0, 0, 0, None, False)


def test_quantile_sweep_edges(spark):
    none = spark.createDataFrame([], "y int, score double")
    assert metrics.quantile_sweep(none).count() == 0
    d = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, 0.8)], "y int, score double")
    rows = sorted(tuple(r) for r in metrics.quantile_sweep(d, points=2).collect())
    assert rows == [(0, 0.1, 1.0, 0.5), (1, 0.9, 0.0, 0.0)]


def test_correlations_share_ranks(spark):
    d = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (2.0, 9.0), (3.0, 16.0), (None, 1.0)], "a double, b double")
    r = metrics.correlations(d, "a", "b").first()
    b = [1, 4, 9, 16]
    assert r.pearson == pytest.approx(np.corrcoef([1, 2, 2, 3], b)[0, 1]) and r.spearman == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1])


def test_samples_and_folds(spark):
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "benign").otherwise("xss").alias("label"), F.when(F.col("id") < 10, "small").when(F.col("id") < 80, "one").otherwise("two").alias("_source"))
    a, b = (sorted(r.doc_id for r in corpus.sample_per_class(x, "label", 7, "doc_id").collect()) for x in (d, d.repartition(9)))
    assert a == b and len(a) == 14
    folds = {r._source: (r.held_out, r.train) for r in corpus.held_out_sources(d, "_source", "label").collect()}
    assert folds == {"one": (70, 130), "two": (120, 80)}
