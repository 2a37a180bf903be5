"""Queries over labels of named sources, leakage, curation and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import corpus, curation, leakage, metrics, policy
from weir.plans import views as V
from weir.plans.registry import query
from weir.sources import labels, readers

BIG = "CAST(count(*) AS BIGINT)"
D, R, L = f"WITH {V.DETECTIONS}", f"WITH {V.REQUESTS}", f"WITH {V.LOG_LINES}"

# Labels


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: One message of each kind, by number; the last three name no class or are none.
_MESSAGES = [
    'Message: a [tag "WEB_ATTACK/SQL_INJECTION"]', 'Message: b [tag "attack-lfi"] [id "930120"]', 'Message: c [tag "WEB_ATTACK/RFI"]', 'Message: d [tag "language-shell"]', 'Message: e [tag "attack-xss"] [tag "attack-sqli"]',
    'Message: f [id "932160"] [tag "web_attack/rce"]', 'Message: g sqli by policy [tag "policy"]', "no alarm", "",
]
_MESSAGE = f"([{_in(_MESSAGES)}])[event_id % {len(_MESSAGES)} + 1]"


def _messages(spark, sf_dir):
    m = F.array(*[F.lit(x) for x in _MESSAGES])
    return V.load(spark, sf_dir, "events").select("event_id", F.get(m, (F.col("event_id") % len(_MESSAGES)).cast("int")).alias("m"))


_NAMED = " ".join(f"WHEN {' OR '.join(f'contains(upper(m), {chr(39)}{p.upper()}{chr(39)})' for p in patterns)} THEN '{c}'" for c, patterns in labels.MESSAGE_PATTERNS.items())


@query(f"WITH k AS (SELECT event_id, {_MESSAGE} AS m FROM events), l AS (SELECT event_id, CASE WHEN NOT contains(m, 'Message:') THEN 'benign' {_NAMED} END AS label FROM k) SELECT event_id, label FROM l WHERE label IS NOT NULL")
def audit_labels(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", readers.message_label(F.col("m")).alias("label")).where("label is not null")


_TAGGED = " ".join(
    f"WHEN {' OR '.join([*(f'list_contains(t, {chr(39)}{x}{chr(39)})' for x in tags), *(f'list_contains(r, {chr(39)}{x}{chr(39)})' for x in rules)])} THEN '{c}'" for c, tags, rules in labels.TAG_CLASSES
)


@query(f"""WITH k AS (SELECT event_id, {_MESSAGE} AS m FROM events), t AS (SELECT event_id, regexp_extract_all(m, '\\[tag "([^"]*)"\\]', 1) AS t, regexp_extract_all(m, '\\[id "([^"]*)"\\]', 1) AS r FROM k)
SELECT event_id, CASE {_TAGGED} END AS label FROM t WHERE CASE {_TAGGED} END IS NOT NULL""")
def tag_labels(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", readers.tag_label(F.col("m")).alias("label")).where("label is not null")


_RAW = ["norm", "SQLi", " xss ", "path-traversal", "cmdi", "other", ""]


@query(f"""WITH k AS (SELECT doc_id, lower(trim(([{_in(_RAW)}])[doc_id % {len(_RAW)} + 1])) AS raw, trim(text, ' ') AS q FROM documents)
SELECT q AS query, CASE raw WHEN 'norm' THEN 'benign' WHEN 'path-traversal' THEN 'path_traversal' ELSE raw END AS label FROM k WHERE raw IN ('norm', 'sqli', 'xss', 'path-traversal', 'cmdi') AND length(q) > 0""")
def labelled_payloads(spark, sf_dir):
    """The documents as a payload list with raw labels of a named source."""
    raw = F.get(F.array(*[F.lit(x) for x in _RAW]), (F.col("doc_id") % len(_RAW)).cast("int"))
    d = V.load(spark, sf_dir, "documents").select(raw.alias("attack_type"), F.col("text").alias("payload"))
    return readers.labelled_payloads(d, payload="payload", label="attack_type", labels=labels.LABELS["payload_full"], source="payload_full", fold=True).select("query", "label")


_FLAG = {"66 - SQL Injection": 2, "126 - Path Traversal": 3, "88 - OS Command Injection": 35, "248 - Command Injection": 5, "242 - Code Injection": 7}


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sqli' WHEN event_id % 3 = 0 THEN 'path_traversal' WHEN event_id % 5 = 0 THEN 'cmdi' ELSE 'xss' END AS label,
CASE WHEN event_id % 4 = 0 THEN 'GET' ELSE 'POST' END AS method, '/p' || (event_id % 9) AS path, 'q=' || event_id AS query, CASE WHEN event_id % 11 = 0 THEN 'host:h' ELSE '' END AS headers
FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0""")
def multilabel_requests(spark, sf_dir):
    e = V.load(spark, sf_dir, "events")
    flags = [(F.col("event_id") % n == 0).cast("int").cast("string").alias(c) for c, n in _FLAG.items()]
    d = e.select(
        *flags, F.when(F.col("event_id") % 4 != 0, "post").alias("request_http_method"), F.concat(F.lit("/p"), (F.col("event_id") % 9).cast("string"), F.lit("?q="), F.col("event_id").cast("string")).alias("request_http_request"),
        F.when(F.col("event_id") % 11 == 0, "h").otherwise("").alias("request_host"),
    )
    r = readers.multilabel_requests(d, labels.MULTILABEL, "capec")
    headers = F.array_join(F.transform(F.map_entries("extra_headers"), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return r.select(F.substring_index("query", "=", -1).cast("bigint").alias("event_id"), "label", "method", "path", "query", headers.alias("headers"))


@query("WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{p.replace(chr(39), chr(39) * 2)}')" for i, p in enumerate(labels.CURATED)) + ") v(line, query)) SELECT CAST(line AS INTEGER) AS line, query, 'cmdi' AS label FROM c")
def curated_payloads(spark, sf_dir):
    return readers.curated_payloads(spark).select("line", "query", "label")


_LINE = "'10.0.0.' || (event_id % 5) || ' - - [01/Jan/2024:00:00:0' || (event_id % 10) || ' +0000] \"GET /p' || (event_id % 3) || '?a=1 HTTP/1.1\" ' || (CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END) || ' 12 \"-\" \"curl/8\"'"


@query("""SELECT event_id AS line, '10.0.0.' || (event_id % 5) AS client_ip, '/p' || (event_id % 3) AS path, 'a=1' AS query, CAST(CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status_code, 'curl/8' AS user_agent
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""")
def access_lines(spark, sf_dir):
    """Log lines by file and number without the labelled ones; many lines have equal texts, some match no format."""
    e = V.load(spark, sf_dir, "events")
    lines = e.select(F.when(F.col("event_id") % 17 == 0, "not a log line").otherwise(F.expr(_LINE)).alias("value"), F.lit("access.log").alias("file"), F.col("event_id").cast("bigint").alias("line"))
    labelled = e.where("event_id % 13 = 0").select(F.lit("access.log").alias("file"), F.col("event_id").alias("line"))
    return readers.access_lines(lines, labelled).select("line", "client_ip", "path", "query", "status_code", "user_agent")


# Leakage: payloads are each class's own and some whole benchmark texts

_PAYLOADS = "payloads AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p.replace(chr(39), chr(39) * 2)}')" for c, p in [*V.PALETTE[1:9], ("sqli", "UNION SELECT user"), ("sqli", "union select USER"), ("cmdi", "no such thing"), ("xss", "ALERT(document"), ("cmdi", "10.0.0.9")]) + ") v(label, payload))"
_SPLIT = f"""{R}, o AS (SELECT *, row_number() OVER (PARTITION BY label, _source ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY label, _source) AS n FROM requests),
split AS (SELECT doc_id, label, path, query, CASE WHEN i <= ceil(n * 0.15::DOUBLE) THEN 'test' WHEN i <= ceil(n * (0.15::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM o), {_PAYLOADS}"""


def _payloads(spark):
    more = [("sqli", "UNION SELECT user"), ("sqli", "union select USER"), ("cmdi", "no such thing"), ("xss", "ALERT(document"), ("cmdi", "10.0.0.9")]
    return spark.createDataFrame([*V.PALETTE[1:9], *more], "label string, payload string")


def _split(spark, sf_dir):
    """Requests of a split by their hash, joined with the corpus's texts; the corpus lacks every 29th."""
    r = V.requests(spark, sf_dir).withColumn("_row_hash", corpus.fingerprint("path", "query", "body", "label"))
    split = corpus.stratified_split(r.select("doc_id", "label", "_source", "_row_hash"), id_col="doc_id")
    return leakage.with_texts(split, r.where("doc_id % 29 <> 0"))


_TEMPLATE = "CASE WHEN label = 'cmdi' THEN regexp_replace(regexp_replace({0}, '[A-Z]{{6}}', 'CANARY', 'g'), '[0-9]+', 'N', 'g') ELSE regexp_replace(lower({0}), '[0-9]+', 'N', 'g') END"
_KNOWN = f"known AS (SELECT split, label, doc_id % 29 = 0 AS missing, CASE WHEN doc_id % 29 = 0 THEN '' ELSE path END AS path, CASE WHEN doc_id % 29 = 0 THEN '' ELSE query END AS query FROM split)"


@query(f"""{_SPLIT}, {_KNOWN}, t AS (SELECT split, label, {_TEMPLATE.format('path')} AS path, {_TEMPLATE.format('query')} AS query FROM known), p AS (SELECT label, payload, {_TEMPLATE.format('payload')} AS template FROM payloads),
b AS (SELECT split, label, CAST(count(*) FILTER (missing) AS BIGINT) AS missing FROM known GROUP BY 1, 2), x AS (SELECT DISTINCT split, label FROM known)
SELECT b.split, b.label, CAST((SELECT count(*) FROM p WHERE p.label = b.label) AS BIGINT) AS total,
CAST((SELECT count(*) FROM p WHERE p.label = b.label AND EXISTS (SELECT 1 FROM known k WHERE k.split = b.split AND k.label = b.label AND (contains(k.path, p.payload) OR contains(k.query, p.payload)))) AS BIGINT) AS exact_matches,
CAST((SELECT count(*) FROM p WHERE p.label = b.label AND EXISTS (SELECT 1 FROM t k WHERE k.split = b.split AND k.label = b.label AND (contains(k.path, p.template) OR contains(k.query, p.template)))) AS BIGINT) AS template_matches, b.missing
FROM b WHERE b.label IN (SELECT label FROM p)""")
def payload_leakage(spark, sf_dir):
    return leakage.payload_leakage(_split(spark, sf_dir), _payloads(spark), fields=("path", "query"))


@query(f"""{_SPLIT}, {_KNOWN}, t AS (SELECT split, {_TEMPLATE.format('path')} AS path, {_TEMPLATE.format('query')} AS query FROM known WHERE label = 'cmdi'), p AS (SELECT DISTINCT payload, {_TEMPLATE.format('payload')} AS template FROM payloads WHERE label = 'cmdi'),
e AS (SELECT DISTINCT k.split, p.payload FROM known k, p WHERE k.label = 'cmdi' AND (contains(k.path, p.payload) OR contains(k.query, p.payload))), m AS (SELECT DISTINCT t.split, p.payload FROM t, p WHERE contains(t.path, p.template) OR contains(t.query, p.template)),
u AS (SELECT split, payload, 'e' AS kind FROM e UNION ALL SELECT split, payload, 'm' FROM m)
SELECT split AS scope, CAST(count(*) FILTER (kind = 'e') AS BIGINT) AS exact_matches, CAST(count(*) FILTER (kind = 'm') AS BIGINT) AS template_matches FROM u GROUP BY 1
UNION ALL SELECT 'sum', CAST(count(*) FILTER (kind = 'e') AS BIGINT), CAST(count(*) FILTER (kind = 'm') AS BIGINT) FROM u
UNION ALL SELECT 'union', CAST(count(DISTINCT payload) FILTER (kind = 'e') AS BIGINT), CAST(count(DISTINCT payload) FILTER (kind = 'm') AS BIGINT) FROM u""")
def leakage_anchor(spark, sf_dir):
    return leakage.anchor(_split(spark, sf_dir), _payloads(spark), fields=("path", "query"))


@query(f"""{R}, f AS (SELECT label, CASE WHEN doc_id % 5 = 0 THEN path || 'x' ELSE path END AS path, query, coalesce(body, '') AS body FROM requests WHERE doc_id % 3 <> 0 AND doc_id % 4 = 1),
r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, label, path, query, coalesce(body, '') AS body FROM requests WHERE doc_id % 3 <> 0),
ft AS (SELECT label, path, query, {_TEMPLATE.format('path')} AS tp, {_TEMPLATE.format('query')} AS tq FROM f), rt AS (SELECT DISTINCT split, label, {_TEMPLATE.format('path')} AS tp, {_TEMPLATE.format('query')} AS tq FROM r),
b AS (SELECT DISTINCT split, label FROM r)
SELECT b.split, b.label, CAST((SELECT count(*) FROM f WHERE f.label = b.label) AS BIGINT) AS total,
CAST((SELECT count(*) FROM f WHERE f.label = b.label AND EXISTS (SELECT 1 FROM r WHERE r.split = b.split AND r.label = f.label AND r.path = f.path AND r.query = f.query)) AS BIGINT) AS exact_matches,
CAST((SELECT count(*) FROM ft WHERE ft.label = b.label AND EXISTS (SELECT 1 FROM rt WHERE rt.split = b.split AND rt.label = ft.label AND rt.tp = ft.tp AND rt.tq = ft.tq)) AS BIGINT) AS template_matches
FROM b WHERE b.label IN (SELECT label FROM f)""")
def fixture_leakage(spark, sf_dir):
    """Fixture requests without bodies against a split of those without bodies, by hash and by hash of templates."""
    r = V.requests(spark, sf_dir).where("doc_id % 3 <> 0")
    f = r.where("doc_id % 4 = 1").withColumn("path", F.when(F.col("doc_id") % 5 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")))
    rows = r.select(F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train").alias("split"), "label", "path", "query", "body", F.lit(False).alias("missing"), corpus.fingerprint("path", "query", "body", "label").alias("_row_hash"))
    return leakage.fixture_leakage(f, rows)


# Curation


def _vectors(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double")).alias("vector"), F.col("label").alias("cluster"))


_HASH = "sha256(array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT) AS VARCHAR)), ',') || '|' || {})"


@query(f"SELECT vec_id AS id, {_HASH.format(repr('sqli'))} AS _row_hash FROM embeddings")
def vector_hashes(spark, sf_dir):
    """Hashes of vectors that went through JSON text, as a telemetry store holds them."""
    v = _vectors(spark, sf_dir).select("id", curation.parse_vector(F.to_json("vector")).alias("vector"))
    return v.select("id", curation.vector_hash(F.col("vector"), F.lit("sqli")).alias("_row_hash"))


@query(f"""WITH d AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'xss' ELSE 'cmdi' END AS l, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS f0, {_HASH.format("(CASE label % 3 WHEN 0 THEN 'xss' ELSE 'cmdi' END)")} AS _row_hash FROM embeddings WHERE label % 3 <> 2)
SELECT id, l AS label, f0, '{curation.SOURCE}' AS _source, _row_hash FROM d""")
def curated_rows(spark, sf_dir):
    """Members of labelled clusters as feature rows; every third cluster is discarded."""
    v = _vectors(spark, sf_dir)
    decisions = v.select("cluster").distinct().withColumn("label", F.when(F.col("cluster") % 3 == 0, "xss").when(F.col("cluster") % 3 == 1, "cmdi"))
    rows = curation.curate(v.select("cluster", "id"), decisions, v, names=[f"f{i}" for i in range(64)])
    return rows.select("id", "label", "f0", "_source", "_row_hash")


@query("SELECT CAST(count(*) AS BIGINT) AS rows, count(*) >= 50 AS due FROM embeddings WHERE label % 3 <> 2")
def training_due(spark, sf_dir):
    return curation.training_due(V.load(spark, sf_dir, "embeddings").where("label % 3 <> 2"))


@query("SELECT max('data/cluster_report_' || lpad(CAST(vec_id AS VARCHAR), 9, '0') || '.json') AS path FROM embeddings WHERE vec_id % 7 <> 0")
def latest_report(spark, sf_dir):
    n = F.lpad(F.col("vec_id").cast("string"), 9, "0")
    paths = V.load(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("data/zz_"), n)).otherwise(F.concat(F.lit("data/cluster_report_"), n, F.lit(".json"))).alias("path"))
    return curation.latest(paths)


@query(f"{R} SELECT {BIG} AS rows, CAST(count(*) FILTER (length(coalesce(body, '')) = 0) AS BIGINT) AS zero, 100.0::DOUBLE * count(*) FILTER (length(coalesce(body, '')) = 0) / count(*) AS percent FROM requests")
def zero_feature_rows(spark, sf_dir):
    r = V.requests(spark, sf_dir).select(F.length(F.coalesce("body", F.lit(""))).alias("body_length"))
    return curation.zero_rows(r, "body_length")


# Evaluation

_SCORED = "e AS (SELECT (['benign','cmdi','path_traversal','sqli','xss'])[event_id % 5 + 1] AS y, event_id, user_id FROM events)"


@query(f"""WITH {_SCORED}, s AS (SELECT k.label, e.y = k.label AS pos, (event_id * (k.i + 7)) % 211 + CASE WHEN e.y = k.label THEN 20 ELSE 0 END AS s FROM e, (VALUES ('benign', 0), ('cmdi', 1), ('path_traversal', 2), ('sqli', 3), ('xss', 4)) k(label, i)),
c AS (SELECT label, s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY label ORDER BY s) - n AS below FROM c)
SELECT label, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 8) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM r GROUP BY 1""")
def auc_by_class(spark, sf_dir):
    classes = policy.CLASSES
    y = F.get(F.array(*[F.lit(c) for c in classes]), (F.col("event_id") % 5).cast("int"))
    e = V.load(spark, sf_dir, "events").select("event_id", y.alias("y"))
    score = F.array(*[((F.col("event_id") * (i + 7)) % 211 + F.when(F.col("y") == c, 20).otherwise(0)).cast("double") for i, c in enumerate(classes)])
    return metrics.auc_by_class(e.withColumn("scores", score), classes).withColumn("auc", F.round("auc", 8))


_EVAL = "WITH e AS (SELECT l.doc_id, l.toxic AS y, CASE WHEN contains(d.text, 'idiot') OR contains(d.text, 'stupid') OR contains(d.text, 'trash') THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d USING (doc_id))"


@query(f"""{_EVAL}, c AS (SELECT k AS label, count(*) FILTER (y = k AND p = k) AS hit, count(*) FILTER (p = k) AS said, count(*) FILTER (y = k) AS support FROM e, (VALUES (0), (1)) v(k) GROUP BY 1),
f AS (SELECT CASE WHEN said + support = 0 THEN 0 ELSE 2 * hit / (said + support) END AS f1, support FROM c) SELECT round(avg(f1), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM f""")
def macro_f1(spark, sf_dir):
    d = V.load(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.col("text").contains("idiot") | F.col("text").contains("stupid") | F.col("text").contains("trash")
    e = V.load(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("toxic").alias("y"), hit.cast("int").alias("p"))
    return metrics.summary(metrics.class_report(e)).withColumns({c: F.round(c, 8) for c in ("macro_f1", "weighted_f1")})


@query(f"""{D} SELECT method AS file, {BIG} AS n, count(*) FILTER (predicted_class = 'benign') / count(*) AS pct_benign FROM detections GROUP BY 1""")
def benign_share(spark, sf_dir):
    return metrics.benign_share(V.detections(spark, sf_dir).withColumnRenamed("method", "file")).drop("classes")


@query(f"{D} SELECT {BIG} AS rows, CAST(count(*) FILTER (event_id % 10 <> 0) AS BIGINT) AS compared, max(CASE WHEN event_id % 10 <> 0 THEN (event_id % 3) / 1000000 END)::DOUBLE AS largest, count(*) FILTER (event_id % 10 = 0) = 0 AS passed FROM detections")
def score_parity(spark, sf_dir):
    """Scores against those of a second run that lacks some rows and differs by up to 2e-6."""
    e = V.detections(spark, sf_dir).select("event_id", F.lit(0.0).alias("score"))
    other = e.where("event_id % 10 <> 0").select("event_id", ((F.col("event_id") % 3) / 1000000).alias("score"))
    return metrics.parity(e, other, "event_id", "score")


@query(f"""{D} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'post' WHEN event_id % 4 = 1 THEN 'get' WHEN event_id % 4 = 2 THEN 'get' ELSE lower(method) END AS method FROM detections""")
def replay_methods(spark, sf_dir):
    k = F.col("event_id") % 4
    e = V.detections(spark, sf_dir)
    return e.select("event_id", policy.replay_method(F.when(k == 0, "").when(k == 1, F.lit(None)).when(k == 2, "TRACE").otherwise(F.col("method")), F.when(k == 0, "a=1")).alias("method"))


@query(f"""{D}, c AS (SELECT event_id, timestamp, verdict, predicted_class, confidence, (['benign','cmdi','path_traversal','sqli','xss'])[event_id % 4 + 1] AS k, (event_id % 10) / 10 AS p FROM detections)
SELECT event_id, timestamp, verdict AS production_verdict, predicted_class AS production_class, confidence AS production_confidence, CASE WHEN k <> 'benign' AND p >= 0.35 THEN 'block' ELSE 'pass' END AS canary_verdict, k AS canary_class, p AS canary_confidence,
(verdict = 'block') = (k <> 'benign' AND p >= 0.35) AS verdict_match, k = predicted_class AS class_match, abs(p - confidence) AS confidence_delta FROM c""")
def canary_comparisons(spark, sf_dir):
    e = V.detections(spark, sf_dir)
    p = (F.col("event_id") % 10) / 10
    canary = e.select("event_id", F.array(*[F.when(F.col("event_id") % 4 == i, p).otherwise(-1.0) for i in range(5)]).alias("probabilities"))
    return policy.compare_canary(e, canary)


@query(f"""{D} SELECT label, {BIG} AS total, CAST(count(*) FILTER (verdict = 'block') AS BIGINT) AS blocked, count(*) FILTER (verdict = 'block') / count(*) AS rate,
CASE WHEN label = 'benign' THEN count(*) FILTER (verdict = 'block') / count(*) <= 0.2 ELSE count(*) FILTER (verdict = 'block') / count(*) >= 0.8 END AS passed FROM (SELECT verdict, predicted_class AS label FROM detections) GROUP BY 1""")
def detection_gate(spark, sf_dir):
    return metrics.detection_gate(V.detections(spark, sf_dir).withColumnRenamed("predicted_class", "label"))


@query()
def parity_inputs(spark, sf_dir):
    """The seeded inputs of a parity check of the classifier."""
    return metrics.parity_inputs(spark)
