"""Queries that train: explanations, reconstruction errors, held-out sources, permuted features."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weir.functions import features
from weir.operators import autoencoder, cluster, corpus, explain, metrics, models, places, quantiles, reports
from weir.plans import views as V
from weir.plans.registry import query

_CLASSES = ["benign", "cmdi", "path_traversal", "sqli", "xss"]


def _features(spark, sf_dir, names):
    return features.extract(V.requests(spark, sf_dir), ("doc_id", "label", "_source")).select("doc_id", "label", "_source", *names)


def _forest(rows, names):
    """The published forest, without the step that reads labels."""
    model = models.classifier("forest", names).fit(models.balanced(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id")))
    return model, model.stages[-1]


@query()
def shap_report(spark, sf_dir):
    """The ten strongest features of each class over all requests, by the published forest."""
    names = features.CLASSIFIER_NAMES
    rows = places.materialise(_features(spark, sf_dir, names))
    model, forest = _forest(rows, names)
    _, cells = explain.shap_cells(rows, forest, names, ("doc_id",))
    report = explain.global_report(cells, names, list(model.stages[0].labelsArray[0]), n="n")
    return report.withColumn("mean_abs", F.round("mean_abs", 5))


@query()
def shap_requests(spark, sf_dir):
    """Each request's class by the published forest, and the eight features that speak loudest for or against it."""
    names = features.CLASSIFIER_NAMES
    rows = places.materialise(_features(spark, sf_dir, names))
    model, forest = _forest(rows, names)
    placed, cells = explain.shap_cells(rows, forest, names, ("doc_id",))
    best = explain.to_rows(placed, explain.strongest(cells, names, list(model.stages[0].labelsArray[0]), ("cell", "n"), top=8))
    parts = F.transform("features", lambda f: F.struct(f["name"].alias("name"), F.round(f["part"], 5).alias("part")))
    return best.select("doc_id", "predicted_class", F.round("confidence", 6).alias("confidence"), parts.alias("features"))


@query()
def autoencoder_errors(spark, sf_dir):
    """Reconstruction errors of the vectors by the published autoencoder, learnt from those of even label."""
    e = V.load(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(64)]
    d = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    model = autoencoder.Autoencoder(names).fit(d.where("label % 2 = 0"))
    return model.transform(d, ("vec_id",)).withColumn("error", F.round("error", 4))


@query()
def left_out_sources(spark, sf_dir):
    """A row a source, for which the languages stand: macro F1 of the published forest that was trained on all others."""
    names = features.CLASSIFIER_NAMES
    rows = _features(spark, sf_dir, names).join(V.requests(spark, sf_dir).select("doc_id", "lang"), "doc_id").drop("_source").withColumnRenamed("lang", "_source")
    found = models.leave_one_source_out(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id").drop("doc_id"), names)
    scores = F.transform(F.array_sort(F.map_entries("f1")), lambda x: F.struct(x["key"].alias("class"), F.round(x["value"]["f1"], 9).alias("f1"), x["value"]["support"].alias("support")))
    return found.select("_source", "rows", F.round("macro_f1", 9).alias("macro_f1"), scores.alias("classes"))


@query()
def permuted_features(spark, sf_dir):
    """The loss of macro F1 on the validation part when a feature is dealt anew, by the published forest of the training part."""
    names = features.CLASSIFIER_NAMES
    rows = places.materialise(corpus.stratified_split(_features(spark, sf_dir, names), id_col="doc_id"))
    model, forest = _forest(rows.where("split = 'train'"), names)
    known = F.array(*[F.lit(x) for x in model.stages[0].labelsArray[0]])

    def predict(d):
        return forest.transform(model.stages[1].transform(d)).withColumn("p", F.get(known, F.col("prediction").cast("int"))).drop("rawPrediction", "probability", "_x")

    found = metrics.permutation_importance(rows.where("split = 'val'"), names, predict, truth="label", id_col="doc_id")
    return found.select("name", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query()
def attacks_inspection(spark, sf_dir):
    """Of each attack type the published forest's figures on the test part, its five strongest features, and the latest events."""
    names = features.CLASSIFIER_NAMES
    rows = places.materialise(corpus.stratified_split(_features(spark, sf_dir, names), id_col="doc_id"))
    model, forest = _forest(rows.where("split = 'train'"), names)
    known = list(model.stages[0].labelsArray[0])
    said = forest.transform(model.stages[1].transform(rows.where("split = 'test'")))
    said = said.select(F.col("label").alias("y"), F.get(F.array(*[F.lit(k) for k in known]), F.col("prediction").cast("int")).alias("p"), vector_to_array("probability").alias("scores"))
    said = places.materialise(said)
    classes = metrics.class_report(said).join(metrics.auc_by_class(said, tuple(known)).select("label", "auc"), "label", "left")
    out = reports.inspection(V.detections(spark, sf_dir), classes, models.importances(model, names, spark))
    return out.withColumns({c: F.round(c, 9) for c in ("f1", "precision", "recall", "auc")}).withColumn("top_features", F.transform("top_features", lambda x: F.struct(x["rank"].alias("rank"), x["feature"].alias("feature"), F.round(x["importance"], 9).alias("importance"))))


_AGREE = "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS compared, 0.0::DOUBLE AS largest, true AS passed FROM"


def _saved(spark) -> str:
    places.checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/model-{uuid.uuid4().hex}"


@query(f"{_AGREE} documents")
def saved_forest_parity(spark, sf_dir):
    """The published forest, saved and loaded again, on all requests: the largest difference of a probability."""
    names = features.CLASSIFIER_NAMES
    rows = places.materialise(_features(spark, sf_dir, names))
    model, forest = _forest(rows, names)
    path = _saved(spark)
    forest.write().save(path)
    ready = model.stages[1].transform(rows)
    score = lambda m: m.transform(ready).select("doc_id", F.array_max(vector_to_array("probability")).alias("score"))
    return metrics.parity(score(forest), score(RandomForestClassificationModel.load(path)), "doc_id", "score")


@query(f"{_AGREE} embeddings")
def saved_isolation_parity(spark, sf_dir):
    """The published isolation forest, saved and loaded again, on all vectors: the largest difference of a score."""
    names = [f"f{i}" for i in range(64)]
    d = V.load(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    forest = models.IsolationForest(names).fit(d, "vec_id")
    path = _saved(spark)
    forest.save(spark, path)
    again = models.IsolationForest.load(spark, path, names)
    return metrics.parity(forest.transform(d, ("vec_id",)), again.transform(d, ("vec_id",)), "vec_id", "if_score")


_NEAR = """p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND list_distance(a.v, b.v) <= 2.5)"""


@query(f"""WITH RECURSIVE {_NEAR}, c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) + 1 >= 3), l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
k AS (SELECT a AS id, least(a, min(b)) AS low FROM l GROUP BY a UNION ALL SELECT id, id FROM c WHERE id NOT IN (SELECT a FROM l)),
r AS (SELECT id, low FROM k UNION SELECT r.id, k.low FROM r JOIN k ON r.low = k.id WHERE k.low < r.low), g AS (SELECT id, min(low) AS cluster FROM r GROUP BY id),
o AS (SELECT n.a AS id, min(g.cluster) AS cluster FROM n JOIN g ON n.b = g.id GROUP BY 1)
SELECT p.id, coalesce(g.cluster, o.cluster) AS cluster FROM p LEFT JOIN g ON p.id = g.id LEFT JOIN o ON p.id = o.id""")
def vector_clusters(spark, sf_dir):
    """Clusters of the 64-dimensional vectors at the published radius and core size.

    The SQL joins all pairs and follows least neighbours; it is written for these
    vectors, which are one cluster.
    """
    e = V.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return cluster.dbscan(e)


_TENTHS = [i / 10 for i in range(11)]


@query(f"""SELECT l_shipmode AS mode, unnest({_TENTHS}::DOUBLE[]) AS point, round(unnest(quantile_cont(l_extendedprice, {_TENTHS})), 6) AS value FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS l_shipmode, l_extendedprice FROM lineitem) GROUP BY 1""")
def price_quantiles(spark, sf_dir):
    """Exact tenths of prices in three groups."""
    k = F.col("l_linenumber") % 3
    d = V.load(spark, sf_dir, "lineitem").select(F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("mode"), "l_extendedprice")
    q = quantiles.quantiles(d, "l_extendedprice", _TENTHS, by="mode")
    points = F.arrays_zip(F.array(*[F.lit(p) for p in _TENTHS]).alias("point"), F.col("q").alias("value"))
    return q.select("mode", F.explode(points).alias("x")).select("mode", "x.point", F.round("x.value", 6).alias("value"))
