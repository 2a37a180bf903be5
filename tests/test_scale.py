"""Operators at sizes and in shapes where a plainer way would fail, against plain versions."""

import datetime
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import autoencoder, cluster, containment, corpus, explain, metrics, models, places, quantiles, temporal


def timed(f):
    start = time.perf_counter()
    out = f()
    return out, time.perf_counter() - start


# Containment


def test_contained_equals_plain_search(spark):
    rng = random.Random(8)
    rows = [(i % 3 or None, rng.choice("ab"), "".join(rng.choice("xyzé") for _ in range(rng.choice([0, 7, 60, 300])))) for i in range(90)] + [(1, "a", None), (1, None, "xyz")]
    needles = [(rng.choice("abc"), "".join(rng.choice("xyzé") for _ in range(rng.randrange(0, 7)))) for _ in range(80)]
    # long ones, cut from the texts, also at their ends
    needles += [(r[1], r[2][k : k + n]) for r in rows if r[1] and r[2] for k, n in ((0, 20), (13, 45), (250, 50), (0, 300))]
    d, p = spark.createDataFrame(rows, "k int, label string, t string"), spark.createDataFrame([*needles, (None, "x")], "label string, needle string")
    got = [tuple(r) for r in containment.contained(d.repartition(5), p, fields=("t",), keys=("k",)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(k, c, w) for k, c, t in rows for n, w in needles if n == c and w and t and w in t}
    assert containment.contained(d, p.limit(0), fields=("t",)).count() == 0 and containment.contained(d.limit(0), p, fields=("t",)).count() == 0


def test_contained_with_100_000_needles(spark):
    # all share a beginning, a third of the texts are one text, and one gram is in every text
    needle = F.concat(F.lit("GET /common/prefix?id="), F.md5(F.col("id").cast("string")))
    needles = spark.range(100_000).select(F.lit("l").alias("label"), needle.alias("needle"))
    body = F.concat(F.lit("GET /common/prefix? hot hot hot hot "), F.when(F.col("id") % 3 == 0, F.concat(F.lit("GET /common/prefix?id="), F.md5(F.lit("7")))).otherwise(F.concat(F.lit("GET /common/prefix?id="), F.md5((F.col("id") * 2).cast("string")))))
    texts = spark.range(20_000).select(F.lit("l").alias("label"), body.alias("t"))
    got, took = timed(lambda: {r.needle[-32:] for r in containment.contained(texts, needles, fields=("t",)).collect()})
    import hashlib

    assert got == {hashlib.md5(str(i).encode()).hexdigest() for i in [7, *[i * 2 for i in range(20_000) if i % 3]]}
    assert took < 120


# Windows


def test_windows_of_a_client_with_a_million_rows(spark):
    start = datetime.datetime(2024, 1, 1)
    # 1,000,000 rows of one client within one window of 60 s, a path of a hundred each
    us = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 50)
    rows = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("client_ip"), us.alias("ts"), (F.col("id") % 100).cast("string").alias("path"), F.when(F.col("id") % 4 == 0, 404).otherwise(200).alias("status_code"))
    out, took = timed(lambda: temporal.temporal_features(rows).agg(F.max("req_count_60s"), F.sum("req_count_1s"), F.min_by("endpoint_diversity_60s", "ts"), F.max("endpoint_diversity_60s"), F.max_by("error_rate_4xx_60s", "ts"), F.count("*")).first())
    in_second = 20_000
    assert out[0] == 999_999 and out[1] == sum(min(i, in_second) for i in range(1_000_000))
    assert out[2] == 0 and out[3] == 100 and out[4] == pytest.approx(250_000 / 999_999) and out[5] == 1_000_000
    assert start.year == 2024 and took < 120


def test_next_of_a_key_over_many_ranges(spark):
    rows = [(k, f"p{i % 4}", i * 3) for k in "ab" for i in range(40 if k == "a" else 1)]
    d = spark.createDataFrame(rows, "c string, p string, t long").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.c, r.p, r.t): r.n for r in places.followed(d, ("c", "p"), "t", "n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {(c, p, t): min((x for k, q, x in rows if (k, q) == (c, p) and x > t), default=None) for c, p, t in rows}


# Quantiles


POINTS = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]
SHAPES = {
    "skewed": lambda rng, n: 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n),
    "tied": lambda rng, n: rng.choice([0.0, -0.0, 1.0, 1.0, 1.0, 7.5], n),
    "close": lambda rng, n: 1.0 + rng.integers(0, 50, n) * np.finfo(float).eps,
    "one": lambda rng, n: np.full(n, -3.25),
    "infinite": lambda rng, n: rng.choice([np.inf, -np.inf, 0.0, 5e-324], n),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_quantiles_equal_a_sort(spark, shape):
    rng = np.random.default_rng(5)
    groups = {"a": SHAPES[shape](rng, 3001), "b": SHAPES[shape](rng, 2), None: SHAPES[shape](rng, 1)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("c", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(4)

    def plain(x):
        s, out = np.sort(x), []
        for p in POINTS:
            at = p * (len(s) - 1)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            out.append(low + (high - low) * (at - int(at)) if at != int(at) and low != high else low)
        return out

    for most, few in ((1 << 16, 1 << 16), (1 << 16, 5), (1, 0)):
        got = {r.g: r.q for r in quantiles.quantiles(d, "v", POINTS, by="g", most=most, few=few, bins=64).collect()}
        assert set(got) == set(groups), (most, few)
        for g, x in groups.items():
            np.testing.assert_array_equal(np.array(got[g]), np.array(plain(x)), err_msg=f"{g} {most} {few}")
    assert quantiles.quantiles(d.where("g = 'c'"), "v", [0.5]).first().q == [None]
    assert quantiles.quantiles(d.where("g = 'c'"), "v", [0.5], by="g").count() == 0


def test_correlations_of_ties(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 300).astype(float), rng.normal(size=300)
    got = metrics.correlations(spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True), (None, 1.0)], "a double, b double"), "a", "b").first()
    mean_rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    assert got.pearson == pytest.approx(np.corrcoef(a, b)[0, 1]) and got.spearman == pytest.approx(np.corrcoef(mean_rank(a), mean_rank(b))[0, 1])


# Density clusters


def plain_dbscan(ids, x, eps, least):
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = {}
    for i in sorted(np.flatnonzero(core), key=lambda k: ids[k]):
        if i in label:
            continue
        stack = [i]
        label[i] = ids[i]
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if j not in label:
                    label[j] = ids[i]
                    stack.append(j)
    return {ids[i]: label[i] if i in label else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None) for i in range(len(ids))}


@pytest.mark.parametrize(("dims", "balls", "side"), [(1, 4096, 20_000), (2, 4096, 7), (3, 4096, 20_000), (5, 4096, 5), (5, 6, 20_000), (20, 4096, 20_000)])
def test_density_clusters_equal_plain(spark, dims, balls, side):
    rng = np.random.default_rng(dims * 100 + balls)
    centres = rng.uniform(-4, 4, (6, dims))
    x = np.concatenate([rng.normal(c, 0.35, (30, dims)) for c in centres] + [rng.uniform(-6, 6, (40, dims))])
    x = np.concatenate([x, np.repeat(x[:2], 5, axis=0), np.full((4, dims), 20.0)])
    ids = [int(i) for i in rng.permutation(len(x)) * 7 + 3]
    rows = [(i, v) for i, v in zip(ids, x.tolist(), strict=True)]
    odd = [(5_000, None), (5_001, [float("nan")] * dims), (5_002, [1.0] * (dims - 1))]
    d = spark.createDataFrame([*rows, *odd], "id long, v array<double>").repartition(3)
    for eps, least in ((0.9, 4), (1.5, 3)):
        got = [(r.id, r.cluster) for r in cluster.dbscan(d, eps, least, balls=balls, side=side).collect()]
        assert len(got) == len(rows) + 3
        assert dict(got) == plain_dbscan(ids, x, eps, least) | {i: None for i, _ in odd}


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i + 1000, i + 1001) for i in range(70)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    d = spark.createDataFrame(edges, "a long, b long").repartition(3)
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    for local in (0, 1 << 20):
        assert {r.id: r.label for r in cluster.connected(d, local).collect()} == label
    assert cluster.connected(d.limit(0)).count() == 0


def test_a_dense_cell_of_100_000_points(spark):
    draw = lambda k: F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 - 0.5) * 0.2 + (k if i == 0 else 0) for i in range(16)])
    dense = spark.range(100_000).select("id", draw(0).alias("v"))
    other = spark.range(100_000, 100_300).select("id", draw(30).alias("v"))
    far = spark.range(200_000, 200_002).select("id", draw(90).alias("v"))
    got, took = timed(lambda: {r.cluster: r.n for r in cluster.dbscan(dense.unionByName(other).unionByName(far)).groupBy("cluster").agg(F.count("*").alias("n")).collect()})
    assert got == {0: 100_000, 100_000: 300, None: 2}
    assert took < 120
    assert cluster.dbscan(dense.limit(0)).count() == 0


# Explanations


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (400, 5)).astype(float)
    y = np.where(x[:, 0] + x[:, 1] > 6, "a", np.where(x[:, 2] > 3, "b", "c"))
    names = [f"f{i}" for i in range(5)]
    d = spark.createDataFrame([(i, *v, str(c)) for i, (v, c) in enumerate(zip(x.tolist(), y, strict=True))], "id long, " + ", ".join(f"{n} double" for n in names) + ", label string")
    model = models.classifier("forest", names, trees=4, depth=5).fit(models.balanced(d))
    return d, names, model


def test_shapley_values_equal_enumeration(spark, forest):
    d, names, model = forest
    trees = explain.nodes_of(model.stages[-1])

    def expected(nodes, x, known, i=0):
        feature, cut, left, right, stats = nodes[i]
        if left < 0:
            return stats / stats.sum()
        if feature in known:
            return expected(nodes, x, known, left if x[feature] <= cut else right)
        return sum(nodes[c][4].sum() / stats.sum() * expected(nodes, x, known, c) for c in (left, right))

    def plain(x):
        value = {s: sum(expected(n, x, s) for n in trees.values()) / len(trees) for k in range(6) for s in map(frozenset, itertools.combinations(range(5), k))}
        out = np.zeros((3, 5))
        for i in range(5):
            for s, v in value.items():
                if i not in s:
                    out[:, i] += math.factorial(len(s)) * math.factorial(4 - len(s)) / math.factorial(5) * (value[s | {i}] - v)
        return out

    some = d.where("id < 12")
    got = {r.id: np.array(r.shap) for r in explain.shap_values(some, model.stages[-1], names, ("id",)).collect()}
    for r in some.collect():
        np.testing.assert_allclose(got[r.id], plain([r[n] for n in names]), atol=1e-12)


def test_shapley_values_add_up_to_the_prediction(spark, forest):
    d, names, model = forest
    values = explain.shap_values(d, model.stages[-1], names, ("id",))
    said = {r.id: r.probability.toArray() for r in model.transform(d).select("id", "probability").collect()}
    for r in values.collect():
        np.testing.assert_allclose(np.array(r.base) + np.array(r.shap).sum(axis=1), said[r.id], atol=1e-9)
    labels = list(model.stages[0].labelsArray[0])
    best = explain.strongest(values, names, labels, ("id",), top=2).collect()
    assert all(labels[int(np.argmax(said[r.id]))] == r.predicted_class and len(r.features) == 2 for r in best if np.ptp(np.sort(said[r.id])[-2:]) > 1e-6)
    report = explain.global_report(values, names, labels, top=3).collect()
    assert len(report) == 9 and next(r.name for r in report if r["class"] == "b" and r.rank == 1) == "f2"


def test_shapley_values_of_one_tree_and_of_a_stump(spark, forest):
    d, names, _ = forest
    for depth in (0, 1):
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.feature import StringIndexer, VectorAssembler

        ready = StringIndexer(inputCol="label", outputCol="_y").fit(d).transform(VectorAssembler(inputCols=names, outputCol="_x").transform(d))
        tree = DecisionTreeClassifier(maxDepth=depth, featuresCol="_x", labelCol="_y").fit(ready)
        r = explain.shap_values(d.limit(3), tree, names, ("id",)).first()
        assert (np.count_nonzero(r.shap) > 0) == (depth == 1)


def test_shapley_values_are_found_once_for_equal_places(spark, forest):
    d, names, model = forest
    labels = list(model.stages[0].labelsArray[0])
    # between two cuts, and beyond the last, values make no difference
    moved = d.select("id", *[(F.col(n) + (F.col("id") % 4) / 100).alias(n) for n in names])
    many = d.select("id", *names).unionByName(moved.withColumn("id", F.col("id") + 400)).unionByName(spark.createDataFrame([(1000, *[float("inf")] * 5), (1001, *[9.0] * 5), (1002, *[float("-inf")] * 5), (1003, *[-1.0] * 5)], ["id", *names]))
    rows, cells = explain.shap_cells(many, model.stages[-1], names, ("id",))
    assert cells.count() <= 402 and cells.agg(F.sum("n")).first()[0] == rows.count() == 804
    got = {r.id: np.array(r.shap) for r in explain.to_rows(rows, cells).collect()}
    assert len(got) == 804 and np.array_equal(got[1000], got[1001]) and np.array_equal(got[1002], got[1003])
    said = {r.id: r.probability.toArray() for r in model.stages[-1].transform(model.stages[1].setHandleInvalid("keep").transform(many)).select("id", "probability").collect()}
    base = np.array(cells.first().base)
    for i, v in got.items():
        np.testing.assert_allclose(base + v.sum(axis=1), said[i], atol=1e-9)
    a = explain.global_report(cells, names, labels, n="n").collect()
    b = explain.global_report(explain.to_rows(rows, cells), names, labels).collect()
    assert [(r["class"], r["rank"], r["name"], round(r.mean_abs, 9)) for r in a] == [(r["class"], r["rank"], r["name"], round(r.mean_abs, 9)) for r in b]
    one = explain.to_rows(rows, explain.strongest(cells, names, labels, ("cell", "n"))).collect()
    two = {r.id: r for r in explain.strongest(explain.to_rows(rows, cells), names, labels, ("id",)).collect()}
    assert len(one) == 804 and all(r.predicted_class == two[r.id].predicted_class and r.features == two[r.id].features for r in one)


# Autoencoder


def plain_training(x, widths, steps, seed):
    """Full-batch Adam in plain numpy, with gradients by differences checked once."""
    w, m, v, losses = autoencoder.start(widths, seed), 0.0, 0.0, []

    def loss(flat):
        a = x
        layers = autoencoder.split(flat, widths)
        for k in range(0, len(layers), 2):
            a = a @ layers[k] + layers[k + 1]
            a = np.maximum(a, 0) if k + 2 < len(layers) else a
        return ((a - x) ** 2).mean()

    # away from the kinks of units that start at 0
    near = w + np.random.default_rng(9).normal(0, 0.1, len(w))
    got = autoencoder.sums(x, near, widths)
    for i in range(0, len(w), 7):
        e = np.zeros(len(w))
        e[i] = 1e-6
        assert got[2 + i] / x.size == pytest.approx((loss(near + e) - loss(near - e)) / 2e-6, abs=1e-6)
    decay = np.concatenate([np.full(int(np.prod(s)), len(s) == 2, float) for s in autoencoder.shapes(widths)])
    for t in range(1, steps + 1):
        losses.append(loss(w))
        g = autoencoder.sums(x, w, widths)[2:] / x.size + autoencoder.DECAY * decay * w / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - autoencoder.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return losses


@pytest.mark.parametrize("parts", [1, 8])
def test_autoencoder_learns_as_plain_numpy(spark, parts):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 2))
    x = np.column_stack([z[:, 0], z[:, 1], z[:, 0] - z[:, 1], np.full(300, 5.0)]) + rng.normal(0, 0.05, (300, 4))
    names = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, a double, b double, c double, d double")
    model = autoencoder.Autoencoder(names, (6, 2, 6), steps=12, held_out=0).fit(d.repartition(parts))
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    np.testing.assert_allclose(model.losses, plain_training(scaled, [4, 6, 2, 6, 4], 12, 42), rtol=1e-9)


def test_autoencoder_finds_what_is_unlike(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(500, 1))
    x = np.column_stack([z, 2 * z, -z, z + 1]) + rng.normal(0, 0.02, (500, 4))
    odd = np.array([[2.0, -2.0, 2.0, -2.0]])
    rows = [(i, *v) for i, v in enumerate(np.concatenate([x, odd]).tolist())]
    d = spark.createDataFrame([*rows, (900, None, None, None, None)], "id long, a double, b double, c double, d double")
    model = autoencoder.Autoencoder(["a", "b", "c", "d"], (8, 2, 8), steps=200).fit(d.where("id < 500"))
    error = {r.id: r.error for r in model.transform(d, ("id",)).collect()}
    assert len(error) == 502 and max((e, i) for i, e in error.items() if i != 900)[1] == 500
    with pytest.raises(ValueError, match="no rows"):
        autoencoder.Autoencoder(["a"]).fit(d.limit(0))


# Held-out sources, permutations


def test_folds_equal_training_each_alone(spark):
    rng = random.Random(2)
    rows = [(s, "b" if v + rng.random() > 1.2 else "a", v, rng.random()) for s in ("s", "t", "u") for v in (rng.random() for _ in range(60))]
    rows += [("u", "never", 9.0, 9.0)] * 5 + [("small", "a", 0.1, 0.1)] * 3 + [(None, "a", 0.1, 0.1)]
    d = spark.createDataFrame(rows, "_source string, label string, x double, z double").coalesce(1)
    got = {r._source: r for r in models.leave_one_source_out(d, ["x", "z"], trees=3, depth=3).collect()}
    assert set(got) == {"s", "t", "u"} and got["u"].f1["never"].f1 == 0.0 and got["u"].f1["never"].support == 5
    kept = places.materialise(d.where("_source is not null"))
    for s in ("s", "t"):
        model = models.classifier("forest", ["x", "z"], trees=3, depth=3).fit(models.balanced(kept.where(F.col("_source") != s)))
        labels = model.stages[0].labelsArray[0]
        said = [(r.label, labels[int(r.prediction)]) for r in model.transform(kept.where(F.col("_source") == s)).collect()]
        f1 = [2 * sum(y == p == c for y, p in said) / (sum(y == c for y, _ in said) + sum(p == c for _, p in said)) for c in sorted({y for y, _ in said})]
        assert got[s].macro_f1 == pytest.approx(sum(f1) / len(f1)) and got[s].rows == 60


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    a, b = (metrics.feistel(np.arange(n), n, k) for k in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n))
    # each place alone, and different keys differ
    assert all(metrics.feistel(np.array([i]), n, 1)[0] == a[i] for i in range(0, n, 7))
    assert n < 64 or (a != b).mean() > 0.8 and (a != np.arange(n)).mean() > 0.8


# Near texts


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("short", [0, 6, 11, 200])
def test_near_texts_equal_all_pairs(spark, short):
    from weir.operators import corpus

    rng = random.Random(short)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = [("x", "prefix-" + word(rng.randrange(1, 16)) + "-end") for _ in range(120)]
    # one label of equal beginnings only, one of a single text, one of texts that are each other's beginnings, the null label
    texts += [("y", "aaaaaaaaaaaaaaaa" + word(rng.randrange(0, 3))) for _ in range(25)] + [("z", "alone"), ("w", "a"), ("w", "ab"), ("w", "abab"), ("w", "ababab"), (None, "n"), ("w", ""), ("w", None), ("w", "q" * 101)]
    rows = [(i, c, s) for i, (c, s) in enumerate(texts)]
    d = spark.createDataFrame(rows, "id long, label string, t string").repartition(3)
    got = [tuple(r) for r in corpus.near_queries(d, id_col="id", label="label", text="t", short=short).collect()]
    first: dict = {}
    for i, c, s in rows:
        if s and len(s) <= 100:
            first.setdefault((c, s), i)
    expected = {(c, min(i, j), max(i, j), k) for (c, s), i in first.items() for (e, o), j in first.items() if i < j and c == e for k in [edits(s, o)] if k <= 2}
    assert len(got) == len(set(got)) and set(got) == expected


def test_pieces_leave_pairs_of_short_texts_to_deletions(spark):
    # ten characters each in eight pieces: any two would share some
    rows = [("l", i, f"{i * 7919 % 10**7:07d} {i % 25:02d}") for i in range(300)]
    d = spark.createDataFrame([*rows, ("l", 1000, rows[5][2] + "xy")], "label string, id long, text string")
    pieces = corpus._by_pieces(d.withColumn("n", F.length("text")), 2, 6, corpus.DELETIONS)
    got = {(r.a, r.b) for r in pieces.collect()}
    assert (5, 1000) in got and all(b == 1000 for _, b in got)
    near = {(r.a, r.b, r.distance) for r in corpus.near_queries(d.withColumnRenamed("text", "t"), id_col="id", label="label", text="t").collect()}
    assert (5, 1000, 2) in near


def test_surroundings_go_on_in_bounded_batches(monkeypatch):
    import types

    import pyarrow as pa

    # every place passes, with 512 bytes before it
    table = types.SimpleNamespace(value=np.full(1 << 16, 1 + containment.reach(np.array([512]))[0], np.uint8))
    texts = ["".join(f"{i:x}," for i in range(8000)), "short", "", "0123456789", "é" * 700]
    monkeypatch.setattr(containment, "READ", 1000)
    search = containment.surroundings(types.SimpleNamespace(mapInArrow=lambda run, _: run), (), table, [3, 8])
    out = list(search(iter([pa.record_batch({"label": ["l"] * len(texts), "text": texts})])))
    expected = set()
    for t in (x.encode() for x in texts):
        expected |= {("l", s, int.from_bytes(t[i : i + s], "little", signed=s == 8), t[max(0, i - 512) : i], t[i : i + s]) for s in (3, 8) for i in range(len(t) - s + 1)}
    assert {tuple(r.values()) for b in out for r in b.to_pylist()} == expected
    # a long text of many places is no batch of its own
    assert sum(b.nbytes for b in out) > 4 * containment.HELD and max(b.nbytes for b in out) < 1.5 * containment.HELD
