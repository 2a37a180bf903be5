"""Queries of the model's life: telemetry, event versions, canaries, clusters, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import cluster, metrics, places, policy, reports
from weir.plans import views as V
from weir.plans.registry import query
from weir.sources import sinks

BIG = "CAST(count(*) AS BIGINT)"
D = f"WITH {V.DETECTIONS}"


@query("SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT nullif('host' || (vec_id % 4), 'host0')) AS BIGINT) AS sources, count(*) > 0 AS healthy FROM embeddings")
def telemetry_health(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings")
    return reports.telemetry_health(e.select(F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("host"), (F.col("vec_id") % 4).cast("string"))).alias("source_id")))


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 10000")
def oldest_telemetry(spark, sf_dir):
    return V.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").orderBy("id").limit(10_000)


@query(f"""{D} SELECT event_id, CAST(event_id % 3 AS BIGINT) AS version, CASE WHEN event_id % 3 = 0 THEN verdict ELSE 'patched' || (event_id % 3) END AS verdict FROM detections""")
def latest_versions(spark, sf_dir):
    e = V.detections(spark, sf_dir).select("event_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 3)).alias("version"), "verdict")
    log = e.withColumn("verdict", F.when(F.col("version") == 0, F.col("verdict")).otherwise(F.concat(F.lit("patched"), F.col("version").cast("string"))))
    return sinks.latest_events(log)


@query(f"""{D}, f AS (SELECT row_number() OVER (ORDER BY event_id) AS request_id, event_id, predicted_class AS expected FROM detections),
r AS (SELECT event_id AS request_id, verdict = 'block' AS was, event_id % 4 <> 0 AS now FROM detections WHERE event_id % 10 <> 3)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(r.request_id) AS BIGINT) AS covered, CAST(count(*) FILTER (expected <> 'benign' AND was AND NOT now) AS BIGINT) AS regressions,
CAST(count(*) FILTER (was = now) AS BIGINT) AS agreed, count(*) FILTER (was = now) / count(r.request_id) AS rate,
count(*) FILTER (expected <> 'benign' AND was AND NOT now) = 0 AND count(*) FILTER (was = now) / count(r.request_id) >= 0.995 AS passed FROM f LEFT JOIN r USING (request_id)""")
def canary_replay(spark, sf_dir):
    e = V.detections(spark, sf_dir)
    fixture = places.numbered(e.select("event_id", F.col("predicted_class").alias("expected")), "event_id")
    rows = e.where("event_id % 10 <> 3").select(F.col("event_id").alias("request_id"), (F.col("verdict") == "block").alias("was"), (F.col("event_id") % 4 != 0).alias("now"))
    return reports.replay_gate(fixture, rows)


@query(f"""WITH m AS (SELECT vec_id AS id, label AS cluster, (vec_id % 50) / 1000 AS s, 'host' || (vec_id % 3) AS h FROM embeddings), c AS (SELECT cluster, h, count(*) AS n FROM m GROUP BY 1, 2)
SELECT cluster, size, mean_score, sources FROM (SELECT cluster, {BIG} AS size, round(avg(s), 8) AS mean_score FROM m GROUP BY 1)
JOIN (SELECT cluster, string_agg(h || ':' || n, ',' ORDER BY h) AS sources FROM c GROUP BY 1) USING (cluster)""")
def cluster_report(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), ((F.col("vec_id") % 50) / 1000).alias("if_score"), F.concat(F.lit("host"), (F.col("vec_id") % 3).cast("string")).alias("source_id"), F.lit("xss").alias("predicted_class"))
    r = cluster.report(e.drop("cluster"), e.select("id", "cluster"))
    sources = F.array_join(F.transform(F.map_entries("source_ids"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return r.select("cluster", "size", F.round("mean_score", 8).alias("mean_score"), sources.alias("sources"))


@query("SELECT label AS cluster, vec_id AS id FROM embeddings WHERE label IS NOT NULL")
def cluster_members(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings")
    return cluster.members(e.select(F.col("vec_id").alias("id")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")))


@query("""WITH m AS (SELECT c_custkey AS id, c_nationkey AS cluster, CAST(c_acctbal AS DOUBLE) AS x FROM customer), t AS (SELECT a.cluster, a.id, round(sum(abs(a.x - b.x)), 9) AS total FROM m a JOIN m b USING (cluster) GROUP BY 1, 2)
SELECT cluster, first(id ORDER BY total, id) AS medoid FROM t GROUP BY 1""")
def cluster_medoids(spark, sf_dir):
    c = V.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster"), F.array(F.col("c_acctbal").cast("double")).alias("v"))
    return cluster.medoids(c)


_PARTS = "SELECT p_size > 25 AS big, CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS f, p_size % 2 AS g, p_size % 3 AS h FROM part"


@query(f"SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (f > 0 AND g = 0 AND h = 0) AS BIGINT) AS alone, 100.0::DOUBLE * count(*) FILTER (f > 0 AND g = 0 AND h = 0) / count(*) AS percent FROM ({_PARTS})")
def lonely_feature(spark, sf_dir):
    p = V.load(spark, sf_dir, "part").select((F.col("p_retailprice") > 1000).cast("int").alias("f"), (F.col("p_size") % 2).alias("g"), (F.col("p_size") % 3).alias("h"))
    return metrics.sole_dependency(p, "f", ["g", "h"])


@query(f"{D}, s AS (SELECT path, count(*) AS n, avg(confidence) AS c FROM detections GROUP BY 1), r AS (SELECT n, c, avg(i) OVER (PARTITION BY n) AS rn, avg(j) OVER (PARTITION BY c) AS rc FROM (SELECT n, c, row_number() OVER (ORDER BY n) AS i, row_number() OVER (ORDER BY c) AS j FROM s)) SELECT round(corr(n, c), 8) AS pearson, round(corr(rn, rc), 8) AS spearman FROM r")
def share_correlation(spark, sf_dir):
    s = V.detections(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return metrics.correlations(s, "n", "c").withColumns({k: F.round(k, 8) for k in ("pearson", "spearman")})


_CLASSES = "WITH e AS (SELECT (['benign','cmdi','sqli','xss'])[p_partkey % 4 + 1] AS y, CASE WHEN p_partkey % 23 = 0 THEN 'benign' ELSE (['benign','cmdi','sqli','xss'])[p_partkey % 4 + 1] END AS p FROM part)"


@query(f"""{_CLASSES}, c AS (SELECT k AS label, count(*) FILTER (y = k AND p = k) AS hit, count(*) FILTER (p = k) AS said, count(*) FILTER (y = k) AS support FROM e, (VALUES ('benign'), ('cmdi'), ('sqli'), ('xss')) v(k) GROUP BY 1),
f AS (SELECT label, support, 2 * hit / (said + support) AS f1 FROM c) SELECT CAST(count(*) FILTER (f1 >= 0.8 AND label <> 'benign') AS BIGINT) AS good_classes, count(*) FILTER (f1 >= 0.8 AND label <> 'benign') >= 3 AS passed FROM f""")
def model_gate(spark, sf_dir):
    k = F.element_at(F.array(*[F.lit(c) for c in ("benign", "cmdi", "sqli", "xss")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    e = V.load(spark, sf_dir, "part").select(k.alias("y"), F.when(F.col("p_partkey") % 23 == 0, "benign").otherwise(k).alias("p"))
    return metrics.metrics_gate(metrics.class_report(e), recall=0.9, fp_rate=0.05)



_POINTS = [i / 299 for i in range(300)]


@query(f"""WITH e AS (SELECT CAST(p_retailprice AS DOUBLE) AS score, CAST(p_size > 25 AS INTEGER) AS y FROM part), q AS (SELECT quantile_cont(score, {_POINTS}) AS q FROM e), t AS (SELECT CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS point, unnest(q) AS threshold FROM q)
SELECT point, round(threshold, 6) AS threshold, count(*) FILTER (y = 1 AND score > threshold) / count(*) FILTER (y = 1) AS recall, count(*) FILTER (y = 0 AND score > threshold) / count(*) FILTER (y = 0) AS fp_rate FROM e, t GROUP BY 1, 2""")
def quantile_sweep(spark, sf_dir):
    e = V.load(spark, sf_dir, "part").select(F.col("p_retailprice").cast("double").alias("score"), (F.col("p_size") > 25).cast("int").alias("y"))
    return metrics.quantile_sweep(e).withColumn("threshold", F.round("threshold", 6))


@query()
def forest_importances(spark, sf_dir):
    """Features of the published forest by importance, the largest ten."""
    from weir.functions import features
    from weir.operators import models

    names = features.CLASSIFIER_NAMES
    d = models.balanced(features.extract(V.requests(spark, sf_dir), ("doc_id", "label")).select("label", *names))
    return models.importances(models.classifier("forest", names).fit(d), names, spark).orderBy(F.desc("importance"), "name").limit(10)
