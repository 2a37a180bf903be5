import hashlib
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.operators import cluster, corpus, curation, leakage, metrics, models, places, policy, reports, temporal, validate

EVENTS = "event_id long, timestamp long, method string, path string, client_ip string, verdict string, predicted_class string, confidence double"
BASE = {"timestamp": 1700000000000, "method": "GET", "path": "/api/users", "client_ip": "203.0.113.5", "verdict": "block", "predicted_class": "sqli", "confidence": 0.9}


def events(spark, *rows):
    return spark.createDataFrame([(i, *(BASE | r).values()) for i, r in enumerate(rows)], EVENTS)


def test_report(spark):
    login = {"path": "/api/login", "method": "POST"}
    e = events(spark, login, login, login | {"predicted_class": "xss"}, {"predicted_class": "cmdi"}, {"verdict": "pass"})
    rows = reports.endpoints_report(e).collect()
    assert [(r.path, r.incident_count, r.top_attack_class, r.attack_types, r.risk_score) for r in rows] == [("/api/login", 3, "sqli", "sqli:2,xss:1", 2.7), ("/api/users", 1, "cmdi", "cmdi:1", 0.9)]
    assert rows[0].top_source_ip == "203.0.113.5"


def test_profile(spark):
    at = lambda h: {"path": "/api/login", "timestamp": 1700006400000 // 86_400_000 * 86_400_000 + h * 3_600_000}
    e = events(spark, at(3), at(3), at(14) | {"client_ip": "198.51.100.20"}, at(14) | {"client_ip": "198.51.100.21", "verdict": "pass_anomaly"})
    p = reports.profile(e, "/api/login")
    assert tuple(reports.profile_totals(p).first()) == (4, 3, 1)
    assert [tuple(r) for r in reports.hourly(p).collect()] == [(3, 2), (14, 2)]
    assert {tuple(r) for r in reports.source_ranges(p).collect()} == {("203.0.113.0/24", 2), ("198.51.100.0/24", 2)}


def test_summary_order_and_range(spark):
    e = events(spark, {"verdict": "pass"}, {"verdict": "pass_anomaly"}, {}, {"timestamp": 1800000000000})
    first, last = reports.day_range("2023-11-14", "2023-11-14")
    assert last - first == 86_400_000 - 1
    assert [r.severity for r in reports.attacks_summary(e, start_ms=first, end_ms=last).collect()] == ["high", "medium", "low"]
    with pytest.raises(ValueError):
        reports.day_range("2024-01-02", "2024-01-01")


def test_limits_and_missing_table(spark):
    assert [reports.checked_limit(x) for x in (3, 0, -1, "x", None, True)] == [3, 10, 10, 10, 10, 10]
    assert reports.endpoints_top(reports.events_or_empty(spark, "no_such_table", EVENTS)).count() == 0
    assert reports.attacks_list(events(spark, {"predicted_class": "benign"})).count() == 0


def test_percentiles_of_nothing(spark):
    assert tuple(reports.index_percentiles(spark.createDataFrame([], "v double"), "v").first()) == (None, None, None)


def test_temporal_hot_client(spark):
    random.seed(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"c{i % 7}", start + datetime.timedelta(seconds=random.random() * 8000), random.choice("abc"), random.choice([200, 404])) for i in range(400)]
    rows += [(None, start, "a", 200), ("hot", None, "a", 200), ("hot", rows[1][1], "z", 404)]
    out = temporal.temporal_features(spark.createDataFrame(rows, "client_ip string, ts timestamp, path string, status_code int")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.client_ip is None or r.ts is None:
            assert r.req_count_60s is None
            continue
        before = [x for x in rows if x[0] == r.client_ip and x[1] is not None and datetime.timedelta(0) < r.ts - x[1] <= datetime.timedelta(seconds=60)]
        assert (r.req_count_60s, r.endpoint_diversity_60s) == (len(before), len({x[2] for x in before}))
        assert r.error_rate_4xx_60s == pytest.approx(sum(x[3] == 404 for x in before) / len(before) if before else 0)


def test_policy(spark):
    given = [([0.2, 0.2, 0.2, 0.2, 0.2], 1.0), ([0.1, 0.0, 0.0, 0.8, 0.1], None), ([0.1, 0.3, 0.2, 0.2, 0.2], 0.001), (None, 0.0), ([0.0, 0.0, 0.0, 0.0, 1.0000004], 0.1)]
    rows = spark.createDataFrame(given, "p array<double>, s double").select(policy.decide(F.col("p"), F.col("s")).alias("d")).select("d.*").collect()
    assert [(r.verdict, r.predicted_class) for r in rows] == [("pass", "benign"), ("block", "sqli"), ("pass_anomaly", "cmdi"), ("timeout", "benign"), ("block", "xss")]
    assert rows[4].confidence == 1.0 and rows[3].confidence == 0.0


def test_late_patches(spark):
    e = spark.createDataFrame([(1, 1000, "pass", 0.0), (2, 1000, "block", 0.0), (3, 1000, "timeout", 0.0), (4, 1000, "pass", 0.0)], "event_id long, timestamp long, verdict string, if_score double")
    r = spark.createDataFrame([(1, 0.001, 1040), (2, 0.001, 1040), (3, 0.001, 1040), (4, 0.001, 1051)], "event_id long, if_score double, replied_at long")
    got = {x.event_id: (x.verdict, x.patched) for x in policy.patch_late(e, r).collect()}
    assert got == {1: ("pass_anomaly", True), 2: ("block", True), 3: ("timeout", False), 4: ("pass", False)}


def test_near_queries_by_brute_force(spark):
    random.seed(2)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    texts = sorted({"".join(random.choice("ab") for _ in range(random.randrange(1, 9))) for _ in range(60)})
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("label", F.lit("x"))
    got = {(r.a, r.b, r.distance) for r in corpus.near_queries(d, id_col="id", label="label", text="t").collect()}
    assert got == {(i, j, edits(texts[i], texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts)) if edits(texts[i], texts[j]) <= 2}


def test_near_queries_with_a_hot_beginning(spark):
    # one label, one beginning in all texts: their pieces bring nobody together
    rng = random.Random(5)
    rows = [(i, "one", f"Customer number 0000{rng.randrange(10**5):05d} x") for i in range(300)] + [(900, "one", "ab"), (901, "one", "abc"), (902, "two", "ab")]
    d = spark.createDataFrame(rows, "id long, label string, t string")
    near = {(r.a, r.b, r.distance) for r in corpus.near_queries(d, id_col="id", label="label", text="t").collect()}
    first = {}
    for i, c, t in rows:
        first.setdefault((c, t), i)
    items = sorted((i, c, t) for (c, t), i in first.items())
    table = spark.createDataFrame([(a[0], b[0], a[2], b[2]) for k, a in enumerate(items) for b in items[k + 1 :] if a[1] == b[1]], "a long, b long, s string, t string")
    assert near == {(r.a, r.b, r.d) for r in table.select("a", "b", F.levenshtein("s", "t").alias("d")).where("d <= 2").collect()}


@pytest.fixture
def many_ranges(spark):
    """Several partitions everywhere: nothing is merged into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_places_hold_over_many_ranges(spark, many_ranges):
    # the input comes from a shuffle, so that ranges are sampled from unordered rows
    d = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("k"), "id").repartition(5, "id").groupBy("id", "k").agg(F.count("*").alias("one"))
    rows = sorted((r.k, r.id) for r in d.collect())
    assert sorted((r.request_id, r.k, r.id) for r in places.numbered(d, "k", "id").collect()) == [(i + 1, *r) for i, r in enumerate(rows)]
    assert sorted(r.id for r in corpus.every_nth(d, 70, "k", "id").collect()) == sorted(rows[k * len(rows) // 70][1] for k in range(70))
    scored = d.select((F.col("id") % 3 == 0).cast("int").alias("y"), F.col("k").cast("double").alias("score"))
    pos = np.array([k for k, i in rows if i % 3 == 0])
    neg = np.array([k for k, i in rows if i % 3])
    won = sum((np.searchsorted(neg, x) + np.searchsorted(neg, x, side="right")) / 2 for x in pos)
    assert metrics.auc(scored).first().auc == pytest.approx(won / len(pos) / len(neg), abs=1e-12)
    values = sorted(k for k, _ in rows)
    assert tuple(reports.index_percentiles(d, "k").first()) == tuple(values[int(len(values) * p)] for p in (0.5, 0.95, 0.99))
    both = d.select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("y"), F.array(F.col("k"), -F.col("k")).alias("scores"))
    assert {r.label: r.auc for r in metrics.auc_by_class(both, ("a", "b")).collect()} == {"a": pytest.approx(metrics.auc(scored).first().auc), "b": pytest.approx(metrics.auc(scored).first().auc)}


def test_lock_hash_is_one_digest(spark, many_ranges):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    d = spark.createDataFrame([(h,) for h in [*hashes, None]], "h string").repartition(6)
    assert tuple(corpus.lock_hash(d, "h").first()) == (hashlib.sha256("\n".join(sorted(hashes)).encode()).hexdigest(), 3000)
    assert tuple(corpus.lock_hash(d.limit(0), "h").first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_permutation_importance_and_sweep(spark):
    d = spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("a"), F.rand(1).alias("b"))
    predict = lambda x: x.withColumn("p", (F.col("a") > 0.5).cast("int"))
    got = {r.name: (r.mean, r.std) for r in metrics.permutation_importance(d, ["a", "b"], predict, repeats=3).collect()}
    assert got["b"] == (0.0, 0.0) and 0.4 < got["a"][0] < 0.6
    variants = spark.createDataFrame([("as it is", None), ("no a", 0.0)], "variant string, a double")
    assert {(r.variant, r.n) for r in metrics.override_sweep(d, variants, predict, names=["a"]).groupBy("variant").agg(F.sum("p").alias("n")).collect()} == {("as it is", 300), ("no a", 0)}


def test_permuted_rows_are_predicted_only_where_a_value_changes(spark):
    d = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("double").alias("a"), F.lit(4.0).alias("b"), F.when(F.col("id") == 7, 1.0).alias("c"))
    seen = []

    def predict(rows):
        seen.append(rows.count())
        return rows.withColumn("p", (F.col("a") > 0.5).cast("int")).drop("_x")

    got = {r.name: (r.mean, r.std) for r in metrics.permutation_importance(d, ["a", "b", "c"], predict, repeats=5).collect()}
    # every row once; then none for b, two a repeat at most for c, and for a no more than 60 a repeat
    assert seen[0] == 60 and sum(seen) <= 60 + 5 * (60 + 2)
    assert got["a"][0] > 0.2 and got["b"] == got["c"] == (0.0, 0.0)


def test_curation_merges_once(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.5]), (2, [1.0, 2.5]), (3, None), (4, [0.0, 1.0])], "id long, vector array<double>")
    assigned = spark.createDataFrame([(7, 1), (7, 2), (7, 3), (8, 4), (None, 5)], "cluster long, id long")
    decisions = spark.createDataFrame([(7, "xss"), (8, None), (9, "nonsense")], "cluster long, label string")
    rows = curation.curate(assigned, decisions, vectors, names=["f", "g"])
    expected = hashlib.sha256(b"1,2.5|xss").hexdigest()
    assert sorted((r.id, r.f, r.g, r.label, r._row_hash) for r in rows.collect()) == [(1, 1.0, 2.5, "xss", expected), (2, 1.0, 2.5, "xss", expected)]
    corpus_rows = spark.createDataFrame([("old", "sqli", 5.0)], "_row_hash string, label string, h double")
    merged = curation.merge_curated(corpus_rows, rows.drop("id"))
    assert merged.count() == 2 and curation.merge_curated(merged, rows.drop("id")).count() == 2
    assert merged.where("_row_hash <> 'old'").first().h == 0.0
    assert curation.latest(spark.createDataFrame([("a/other.json",)], "path string")).count() == 0


def test_network_and_reconstruction(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(6, 1, (150, 3))])
    d = spark.createDataFrame([(i, "b" if i < 150 else "x", *map(float, r)) for i, r in enumerate(x)], "id long, label string, f double, g double, h double")
    m = models.network(["f", "g", "h"], 2, hidden=(4,), steps=60).fit(d)
    assert m.transform(d).where("prediction = _y").count() > 285
    line = [(i, t, 2.0 * t, 3.0 * t) for i, t in enumerate(rng.normal(0, 1, 200).tolist())]
    r = models.Reconstruction(["f", "g", "h"], narrow=1).fit(spark.createDataFrame(line, "id long, f double, g double, h double"))
    odd = spark.createDataFrame([*line[:50], (999, 3.0, -6.0, 0.0)], "id long, f double, g double, h double")
    errors = {q.id: q.error for q in r.transform(odd, ("id",)).collect()}
    assert max(errors, key=errors.get) == 999 and errors[0] < 1e-9


def test_comparison_of_models(spark):
    rows = metrics.comparison({"a": {"macro_f1": 0.5, "size_bytes": 2048, "p95_ms": 1.0}, "b": {"recall": 0.9, "fp_rate": 0.05, "size_bytes": 3 << 20}}, spark).collect()
    assert [(r.model, r.kind, r.size) for r in rows] == [("a", "supervised", "2.0 KB"), ("b", "unsupervised", "3.00 MB")]


def test_split_is_disjoint_and_stable(spark):
    d = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.lit("s").alias("_source"))
    a, b = (sorted((r.k, r.split) for r in corpus.stratified_split(x, id_col="k").collect()) for x in (d, d.repartition(7)))
    assert a == b and len(a) == 2000
    assert sum(s == "test" for _, s in a) in range(298, 304)
    s = corpus.stratified_split(d, id_col="k")
    assert corpus.split_overlap(s, "k").count() == 0 and not corpus.split_drift(s, "label").where("not within").count()


def test_templates(spark):
    r = spark.createDataFrame([("echo ABCDEF 12;x9",), ("A%20b%2",)], "t string").select(corpus.template_shape(F.col("t")), corpus.generic_template(F.col("t"))).collect()
    assert r[0][0] == "echo CANARY N;xN" and r[1][1] == "a b%N"


def test_backfill(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "x int, f double"), spark.createDataFrame([(3, "s")], "x int, t string")
    assert {(r.x, r.f, r.t) for r in corpus.backfill_union(a, b).collect()} == {(1, 2.0, None), (3, 0.0, "s")}


def test_containment(spark):
    rows = spark.createDataFrame([("sqli", "/a", "id=1 OR 1=1", ""), ("xss", "/b", "<b>", "")], "label string, path string, query string, body string")
    p = spark.createDataFrame([("sqli", "OR 1=1"), ("sqli", "nowhere"), ("xss", "OR 1=1"), ("xss", "")], "label string, payload string")
    assert {tuple(r) for r in leakage.containment(rows, p).collect()} == {("sqli", 2, 1), ("xss", 1, 0)}
    templated = leakage.containment(rows, spark.createDataFrame([("sqli", "or 7=9")], "label string, payload string"), template=corpus.generic_template)
    assert templated.first().matches == 1


def test_metrics_edges(spark):
    none = spark.createDataFrame([], "y int, p int, score double")
    assert metrics.class_report(none).count() == 0 and metrics.threshold_sweep(none).count() == 0
    one = spark.createDataFrame([(1, 0, 0.2), (0, 0, 0.2)], "y int, p int, score double")
    assert {r.label: r.f1 for r in metrics.class_report(one).collect()} == {0: pytest.approx(2 / 3), 1: 0.0}
    assert metrics.auc(one).first().auc == 0.5


def test_telemetry_validation(spark):
    from weir.functions.features import NAMES

    good = ([0.0] * len(NAMES), "sqli", 0.5, 5, "h")
    rows = [good, ([0.0], *good[1:]), (good[0], "odd", *good[2:]), (*good[:2], 1.5, *good[3:]), (*good[:4], ""), ([float("inf")] * len(NAMES), *good[1:]), (*good[:3], 0, "h")]
    d = spark.createDataFrame(rows, "vector array<double>, predicted_class string, confidence double, timestamp long, source_id string")
    valid, bad = validate.split_valid(d, validate.telemetry_error())
    assert valid.count() == 1
    assert [r.error.split()[0] for r in bad.collect()] == ["vector", "predicted_class", "confidence", "source_id", "vector", "timestamp"]
    assert validate.contract_errors(NAMES) == [] and validate.contract_errors(NAMES[1:]) == ["missing payload_length"]


def test_isolation_forest_finds_outliers(spark):
    random.seed(3)
    rows = [(i, random.gauss(0, 1), random.gauss(0, 1)) for i in range(400)] + [(1000, 12.0, -11.0), (1001, None, None)]
    d = spark.createDataFrame(rows, "id long, a double, b double")
    scores = {r.id: r.if_score for r in models.IsolationForest(["a", "b"], trees=60, samples=128).fit(d, "id").transform(d, ("id",)).collect()}
    assert min(scores, key=scores.get) == 1000 and scores[1000] < 0 < scores[1001]
    assert sum(s < 0 for s in scores.values()) < 60


def test_classifiers(spark):
    random.seed(4)
    rows = [("b" if i % 4 else "a", random.gauss(3 * (i % 4 > 0), 1), random.random()) for i in range(300)]
    d = models.balanced(spark.createDataFrame(rows, "label string, x double, z double"))
    for kind in ("forest", "tree", "logistic"):
        m = models.classifier(kind, ["x", "z"], trees=5, depth=5).fit(d)
        assert m.transform(d).where("prediction = _y").count() > 240


def test_clusters_and_medoids(spark):
    pts = [(i, [float(i % 3) * 0.1 + 10 * (i // 5), 0.0]) for i in range(15)] + [(99, [500.0, 500.0])]
    d = spark.createDataFrame(pts, "id long, v array<double>")
    c = cluster.dbscan(d, eps=0.5, min_samples=3)
    got = {r.id: r.cluster for r in c.collect()}
    assert got == {i: i // 5 * 5 for i in range(15)} | {99: None}
    m = {r.cluster: r.medoid for r in cluster.medoids(d.join(c, "id").where("cluster is not null")).collect()}
    assert set(m) == {0, 5, 10}


@pytest.mark.parametrize("dims", [1, 2])
def test_medoids_of_large_clusters_are_exact(spark, dims):
    rng = np.random.default_rng(dims)
    # all but a few of a large cluster's members lie apart from its middle
    x = np.round(np.concatenate([rng.normal(0, 1, (2400, dims)), rng.normal(9, 1, (2600, dims)), rng.normal(5, 9, (7, dims))]), 2)
    label = [1] * 5000 + [2] * 7
    d = spark.createDataFrame([(c, i, v) for i, (c, v) in enumerate(zip(label, x.tolist(), strict=True))], "cluster long, id long, v array<double>")
    expected = {}
    for c in (1, 2):
        own = np.flatnonzero(np.array(label) == c)
        total = np.array([np.sqrt(((x[own] - x[i]) ** 2).sum(1)).sum() for i in own])
        expected[c] = int(own[np.flatnonzero(total <= total.min() + 1e-6)[0]])
    assert {r.cluster: r.medoid for r in cluster.medoids(d.repartition(3)).collect()} == expected
    assert cluster.medoids(d.limit(0)).count() == 0


def test_inspection_of_attack_types(spark):
    events = spark.createDataFrame([(i, "sqli" if i % 2 else "xss", f"/p{i}", "q") for i in range(8)] + [(9, "benign", "/", "")], "event_id long, predicted_class string, path string, query_string string")
    classes = spark.createDataFrame([("sqli", 0.5, 0.6, 0.4, 0.9), ("cmdi", 0.1, 0.1, 0.1, 0.5), ("benign", 1.0, 1.0, 1.0, 1.0)], "label string, f1 double, precision double, recall double, auc double")
    importances = spark.createDataFrame([(f"f{i}", i / 10) for i in range(7)] + [("a", 0.6)], "name string, importance double")
    got = {r.attack_type: r for r in reports.inspection(events, classes, importances).collect()}
    assert set(got) == {"sqli", "xss", "cmdi"} and got["xss"].f1 is None and got["cmdi"].payload_examples is None and got["sqli"].recall == 0.4
    assert [e.event_id for e in got["sqli"].payload_examples] == [7, 5, 3]
    assert [(f["rank"], f.feature) for f in got["cmdi"].top_features] == [(1, "a"), (2, "f6"), (3, "f5"), (4, "f4"), (5, "f3")]


def test_overlap_of_empty_sides(spark):
    from weir.operators import similarity

    d = spark.createDataFrame([(1, "a long enough text here", "c"), (2, "a long enough text hero", "c"), (3, "short", "c"), (4, None, None)], "id long, t string, label string")
    some = lambda a, b: [tuple(r) for r in similarity.overlap_with_classes(a, b, id_col="id", text="t", label="label").collect()]
    assert some(d.where("id <> 2"), d.where("id = 2")) == [("c", 3, 1, 2, 1, 1.0, True, "a long enough text here")]
    assert some(d.limit(0), d.where("id = 2")) == [("c", 0, 0, 0, 0, 0.0, False, None)] and some(d, d.limit(0)) == []
