"""Queries over parsed text: URLs, labels, tags, templates, text overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import corpus, similarity, validate
from weir.plans import views as V
from weir.plans.registry import query
from weir.sources import readers

BIG = "CAST(count(*) AS BIGINT)"
D, R, L = f"WITH {V.DETECTIONS}", f"WITH {V.REQUESTS}", f"WITH {V.LOG_LINES}"


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', '') || CASE WHEN page_id % 3 = 0 THEN '?a=1?b' ELSE '' END AS r FROM pages)
SELECT page_id, CASE WHEN contains(r, '?') THEN substr(r, 1, strpos(r, '?') - 1) ELSE r END AS path, CASE WHEN contains(r, '?') THEN substr(r, strpos(r, '?') + 1) ELSE '' END AS query FROM u""")
def url_parts(spark, sf_dir):
    p = V.load(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 3 == 0, "?a=1?b").otherwise("")).alias("url"))
    return p.select("page_id", readers.split_url(F.col("url")).alias("u")).select("page_id", "u.*")


_FLAGS = {"sqli": 2, "path_traversal": 3, "cmdi": 5, "xss": 7}


def _flags():
    return {c: F.col("event_id") % n == 0 for c, n in _FLAGS.items()}


def _case(order, default):
    return "CASE " + " ".join(f"WHEN event_id % {_FLAGS[c]} = 0 THEN '{c}'" for c in order) + f" ELSE {default} END"


@query(f"SELECT event_id, {_case(readers.PRIORITY, 'NULL')} AS label FROM events WHERE {_case(readers.PRIORITY, 'NULL')} IS NOT NULL")
def label_by_priority(spark, sf_dir):
    return V.load(spark, sf_dir, "events").select("event_id", readers.priority_label(_flags()).alias("label")).where("label IS NOT NULL")


@query(f"SELECT event_id, {_case(('sqli', 'cmdi', 'path_traversal', 'xss'), repr('legitimate'))} AS label FROM events")
def label_or_legitimate(spark, sf_dir):
    return V.load(spark, sf_dir, "events").select("event_id", readers.priority_label(_flags(), "legitimate", ("sqli", "cmdi", "path_traversal", "xss")).alias("label"))


@query("SELECT CAST(" + " + ".join(f"CAST(event_id % {n} = 0 AS INTEGER)" for n in _FLAGS.values()) + f" AS INTEGER) AS labels, {BIG} AS n FROM events GROUP BY 1")
def labels_per_row(spark, sf_dir):
    flags = [f.cast("int") for f in _flags().values()]
    return V.load(spark, sf_dir, "events").groupBy(sum(flags[1:], flags[0]).alias("labels")).agg(F.count("*").alias("n"))


_MESSAGE = "'Message: x [id \"' || (user_id % 40) || '\"] [tag \"' || event_type || '\"] [tag \"kind-' || (event_id % 6) || '\"] [tag \"' || event_type || '\"]'"


@query(f"SELECT tag, {BIG} AS n FROM (SELECT unnest(list_distinct(regexp_extract_all({_MESSAGE}, '\\[tag \"([^\"]*)\"\\]', 1))) AS tag FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def top_tags(spark, sf_dir):
    m = V.load(spark, sf_dir, "events").select(F.expr(_MESSAGE).alias("m"))
    return m.select(F.explode(readers.tags_of(F.col("m"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(8)


@query(f"SELECT rule, {BIG} AS n FROM (SELECT unnest(regexp_extract_all({_MESSAGE}, '\\[id \"([^\"]*)\"\\]', 1)) AS rule FROM events) GROUP BY 1")
def rule_counts(spark, sf_dir):
    m = V.load(spark, sf_dir, "events").select(F.expr(_MESSAGE).alias("m"))
    return m.select(F.explode(readers.tags_of(F.col("m"), "id")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"{R} SELECT doc_id, CASE WHEN length(coalesce(body, '')) > 0 THEN body WHEN length(query) > 0 THEN query ELSE path END AS raw FROM requests")
def raw_texts(spark, sf_dir):
    return V.requests(spark, sf_dir).select("doc_id", similarity.raw_text().alias("raw"))


@query(f"""{R} SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing method' WHEN label NOT IN ('benign', 'cmdi', 'path_traversal', 'sqli', 'xss') OR doc_id % 10 = 1 THEN 'unknown label' ELSE 'valid' END AS reason, {BIG} AS n FROM requests GROUP BY 1""")
def request_reasons(spark, sf_dir):
    r = V.requests(spark, sf_dir).withColumns({"method": F.when(F.col("doc_id") % 10 != 0, F.col("method")), "label": F.when(F.col("doc_id") % 10 != 1, F.col("label"))})
    return validate.reason_counts(r, validate.request_error())


_NAMES = "n AS (SELECT min(p_partkey) AS id, p_name || ' ' || p_brand || ' ' || p_type AS t FROM part GROUP BY 2)"
_PAIRS = f"""WITH {_NAMES}, s AS (SELECT id, list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS s FROM n WHERE length(t) >= 15),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON a.id < b.id AND least(len(a.s), len(b.s)) >= 0.70 * greatest(len(a.s), len(b.s))),
k AS (SELECT a, b, i / (x + y - i) AS similarity FROM p WHERE i / (x + y - i) >= 0.70)"""


def _names(spark, sf_dir):
    p = V.load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("t"))
    return similarity.overlap_pairs(p, id_col="p_partkey", text="t")


@query(f"{_PAIRS} SELECT a, b, round(similarity, 8) AS similarity FROM k")
def shingle_overlap(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("similarity", F.round("similarity", 8))


@query(f"{_PAIRS}, e AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM k UNION ALL SELECT b FROM k) GROUP BY 1) SELECT CAST(coalesce(sum(n), 0) / 2 AS BIGINT) AS pairs, {BIG} AS texts, round(avg(n), 8) AS mean_neighbours, CAST(max(n) AS BIGINT) AS most_neighbours FROM e")
def overlap_saturation(spark, sf_dir):
    return similarity.saturation(_names(spark, sf_dir)).withColumn("mean_neighbours", F.round("mean_neighbours", 8))


@query("""WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS t, p_partkey % 5 = 0 AS file, 'c' || (p_size % 3) AS label FROM part),
s AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS s FROM t WHERE length(t) >= 15),
m AS (SELECT DISTINCT a.id, a.t, b.label FROM s a JOIN s b ON a.file AND NOT b.file AND least(len(a.s), len(b.s)) >= 0.70 * greatest(len(a.s), len(b.s)) WHERE len(list_intersect(a.s, b.s)) >= 0.70 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
h AS (SELECT label, count(*) AS matched, first(t ORDER BY id) AS example FROM m GROUP BY 1), n AS (SELECT count(*) AS total, count(*) FILTER (length(t) >= 15) AS evaluated FROM t WHERE file)
SELECT c.label, CAST(total AS BIGINT) AS total, CAST(evaluated AS BIGINT) AS evaluated, CAST(total - evaluated AS BIGINT) AS excluded, CAST(coalesce(matched, 0) AS BIGINT) AS matched, round(coalesce(matched, 0) / evaluated, 8) AS share,
coalesce(matched, 0) / evaluated > 0.01 AS flagged, substr(example, 1, 120) AS example FROM (SELECT DISTINCT label FROM t WHERE NOT file) c LEFT JOIN h USING (label), n""")
def overlap_by_class(spark, sf_dir):
    """Every fifth part as a file, the others as three classes."""
    p = V.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("t"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("label"))
    file, others = p.where("id % 5 = 0").drop("label"), p.where("id % 5 <> 0")
    return similarity.overlap_with_classes(file, others, id_col="id", text="t", label="label").withColumn("share", F.round("share", 8))


@query(f"{L}, k AS (SELECT event_id FROM log_lines WHERE status_code = 404) SELECT event_id, client_ip, path FROM log_lines WHERE event_id NOT IN (SELECT event_id FROM k)")
def unlabelled_lines(spark, sf_dir):
    lines = V.log_lines(spark, sf_dir)
    return lines.join(lines.where("status_code = 404").select("event_id"), "event_id", "left_anti").select("event_id", "client_ip", "path")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 7 AS INTEGER) AS host FROM events")
def dealt_to_hosts(spark, sf_dir):
    return readers.over_hosts(V.load(spark, sf_dir, "events").select("event_id"), 7, "event_id")


@query(f"""{R} SELECT doc_id, label FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS i FROM requests) WHERE i <= 20""")
def sample_per_class(spark, sf_dir):
    return corpus.sample_per_class(V.requests(spark, sf_dir).select("doc_id", "label"), "label", 20, "doc_id")


@query(f"""{R}, s AS (SELECT _source, count(*) AS n, count(*) FILTER (label = 'benign') AS b FROM requests GROUP BY 1)
SELECT _source, CAST(n AS BIGINT) AS held_out, CAST(sum(n) OVER () - n AS BIGINT) AS train, round(b / n, 8) AS benign_share FROM s WHERE n >= 30""")
def held_out_sources(spark, sf_dir):
    return corpus.held_out_sources(V.requests(spark, sf_dir), "_source", "label").withColumn("benign_share", F.round("benign_share", 8))


@query("""SELECT c_custkey, CASE WHEN regexp_matches('10.' || (c_nationkey % 7) || '.0.' || (c_custkey % 250), '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN '10.' || (c_nationkey % 7) || '.0.0/24' END AS subnet,
'v' || (c_nationkey + 1) AS version, regexp_replace('p=' || c_name, '^p=', '') AS name, log10(c_custkey + 1) AS magnitude FROM customer""")
def scalar_helpers(spark, sf_dir):
    from weir.functions import text

    c = V.load(spark, sf_dir, "customer")
    ip = F.concat(F.lit("10."), (F.col("c_nationkey") % 7).cast("string"), F.lit(".0."), (F.col("c_custkey") % 250).cast("string"))
    return c.select("c_custkey", text.subnet(ip).alias("subnet"), text.next_version(F.concat(F.lit("v"), F.col("c_nationkey").cast("string"))).alias("version"), F.regexp_replace(F.concat(F.lit("p="), "c_name"), "^p=", "").alias("name"), F.log10(F.col("c_custkey") + 1).alias("magnitude"))
