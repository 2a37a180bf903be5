"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import features, text
from weir.functions import patterns as P
from weir.operators import cluster, corpus, leakage as leaks, metrics, models, policy, reports, temporal, validate
from weir.plans import corpora, feature_sql, learning, lifecycle, parsing  # noqa: F401  they register their queries
from weir.plans import views as V
from weir.plans.registry import ORACLE, QUERIES, query

DAY_MS = 86_400_000


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every request, and a rule of thumb on marker counts, not a trained model, that decides on them."""
    return request_decisions(spark, sf_dir)


D, R, L = f"WITH {V.DETECTIONS}", f"WITH {V.REQUESTS}", f"WITH {V.LOG_LINES}"
BIG = "CAST(count(*) AS BIGINT)"
BLOCKED = "CAST(count(*) FILTER (verdict = 'block') AS BIGINT)"
ANOMALOUS = "CAST(count(*) FILTER (verdict = 'pass_anomaly') AS BIGINT)"
INCIDENT = "verdict IN ('block', 'pass_anomaly')"
RISK = "floor(count(*) * avg(confidence) * 100 + 0.5) / 100"


# Reports


@query(f"{D} SELECT predicted_class, {BIG} AS total_count, max(timestamp) AS last_detected FROM detections WHERE predicted_class <> 'benign' GROUP BY 1")
def attacks_list(spark, sf_dir):
    return reports.attacks_list(V.detections(spark, sf_dir))


_SUMMARY = f"SELECT path, method, CASE verdict WHEN 'block' THEN 'high' WHEN 'pass_anomaly' THEN 'medium' ELSE 'low' END AS severity, predicted_class, {BIG} AS count FROM detections WHERE predicted_class <> 'benign'"


@query(f"{D} {_SUMMARY} GROUP BY ALL")
def attacks_summary(spark, sf_dir):
    return reports.attacks_summary(V.detections(spark, sf_dir))


@query(f"{D} {_SUMMARY} AND path = '/api/r3' AND method = 'POST' AND timestamp BETWEEN 1704067200000 AND 1735689599999 GROUP BY ALL")
def attacks_summary_filtered(spark, sf_dir):
    first, last = reports.day_range("2024-01-01", "2024-12-31")
    return reports.attacks_summary(V.detections(spark, sf_dir), start_ms=first, end_ms=last, endpoint="/api/r3", method="post")


@query(f"{D} SELECT event_id, path, query_string FROM detections WHERE predicted_class = 'sqli' ORDER BY event_id DESC LIMIT 3")
def attacks_inspect(spark, sf_dir):
    return reports.attack_examples(V.detections(spark, sf_dir), "sqli")


@query(f"{D} SELECT path, method, {BIG} AS incident_count, {RISK} AS risk_score FROM detections WHERE {INCIDENT} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def endpoints_top(spark, sf_dir):
    return reports.endpoints_top(V.detections(spark, sf_dir))


@query(f"""{D}, i AS (SELECT * FROM detections WHERE {INCIDENT}),
c AS (SELECT path, method, predicted_class, count(*) AS n FROM i GROUP BY ALL), s AS (SELECT path, method, client_ip, count(*) AS n FROM i WHERE client_ip <> '' GROUP BY ALL),
c2 AS (SELECT path, method, string_agg(predicted_class || ':' || n, ',' ORDER BY n DESC, predicted_class) AS attack_types, first(predicted_class ORDER BY n DESC, predicted_class) AS top_attack_class FROM c GROUP BY 1, 2),
s2 AS (SELECT path, method, first(client_ip ORDER BY n DESC, client_ip) AS top_source_ip FROM s GROUP BY 1, 2),
t AS (SELECT path, method, {BIG} AS incident_count, {BLOCKED} AS block_count, {ANOMALOUS} AS pass_anomaly_count, {RISK} AS risk_score FROM i GROUP BY 1, 2)
SELECT t.*, top_attack_class, attack_types, coalesce(top_source_ip, '') AS top_source_ip FROM t JOIN c2 USING (path, method) LEFT JOIN s2 USING (path, method)""")
def endpoints_report(spark, sf_dir):
    return reports.endpoints_report(V.detections(spark, sf_dir))


_PROFILE = f"{D}, i AS (SELECT * FROM detections WHERE {INCIDENT} AND path = '/api/r7')"


def _profile(spark, sf_dir):
    return reports.profile(V.detections(spark, sf_dir), "/api/r7")


@query(f"{_PROFILE} SELECT {BIG} AS total_incidents, {BLOCKED} AS block_count, {ANOMALOUS} AS pass_anomaly_count FROM i")
def profile_totals(spark, sf_dir):
    return reports.profile_totals(_profile(spark, sf_dir))


@query(f"{_PROFILE} SELECT method, {BIG} AS count FROM i GROUP BY 1")
def profile_methods(spark, sf_dir):
    return reports.counts_by(_profile(spark, sf_dir), "method")


@query(f"{_PROFILE} SELECT predicted_class, {BIG} AS count FROM i GROUP BY 1")
def profile_classes(spark, sf_dir):
    return reports.counts_by(_profile(spark, sf_dir), "predicted_class")


@query(f"{_PROFILE} SELECT CAST(hour(make_timestamp(timestamp * 1000)) AS INTEGER) AS hour, {BIG} AS count FROM i GROUP BY 1")
def profile_hourly(spark, sf_dir):
    return reports.hourly(_profile(spark, sf_dir))


_IPS = f"SELECT client_ip, {BIG} AS count FROM i WHERE client_ip <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"


@query(f"{_PROFILE} {_IPS}")
def profile_sources(spark, sf_dir):
    return reports.top_sources(_profile(spark, sf_dir))


@query(f"{_PROFILE}, t AS ({_IPS}) SELECT regexp_replace(client_ip, '\\.[0-9]+$', '.0/24') AS client_ip, CAST(sum(count) AS BIGINT) AS count FROM t GROUP BY 1")
def profile_ranges(spark, sf_dir):
    return reports.source_ranges(_profile(spark, sf_dir))


@query(f"""{D}, r AS (SELECT regexp_replace(path, '/\\d+', '/:id', 'g') AS route, CASE WHEN user_agent LIKE 'Mozilla%' THEN 'browser' ELSE 'other' END AS agent, verdict, predicted_class FROM detections),
p AS (SELECT route, agent, predicted_class, count(*) AS n, count(*) FILTER (verdict = 'block') AS b FROM r GROUP BY 1, 2, 3)
SELECT route, agent, CAST(sum(n) AS BIGINT) AS total, CAST(sum(b) AS BIGINT) AS blocked, string_agg(predicted_class || ':' || n, ',' ORDER BY predicted_class) AS classes, sum(b) / sum(n) AS block_rate FROM p GROUP BY 1, 2""")
def user_agent_rates(spark, sf_dir):
    return reports.user_agent_rates(V.detections(spark, sf_dir))


@query(f"{D} SELECT predicted_class, {BIG} AS total, {BLOCKED} AS blocked, count(*) FILTER (verdict = 'block') / count(*) AS rate, count(*) FILTER (verdict = 'block') / count(*) >= 0.8 AS passed FROM detections GROUP BY 1")
def blocked_by_class(spark, sf_dir):
    return reports.blocked_by_class(V.detections(spark, sf_dir))


@query(f"{D} SELECT predicted_class, 100 * avg(CASE WHEN length(user_agent) > 40 THEN 1.0 ELSE 0.0 END) AS percent FROM detections GROUP BY 1")
def long_agents(spark, sf_dir):
    return reports.long_agents(V.detections(spark, sf_dir))


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT max(value) FILTER (i = floor(n * 0.5)) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM s""")
def latency_percentiles(spark, sf_dir):
    return reports.index_percentiles(V.load(spark, sf_dir, "events"), "value")


@query(f"{D} SELECT CAST(timestamp // 3600000 * 3600000 AS BIGINT) AS start, predicted_class, {BIG} AS count FROM detections WHERE predicted_class <> 'benign' GROUP BY 1, 2")
def attacks_by_hour(spark, sf_dir):
    return reports.tumbling_attacks(V.detections(spark, sf_dir))


# Windows per client

_RANGE = "PARTITION BY client_ip ORDER BY ts RANGE BETWEEN INTERVAL {} SECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def _temporal_sql(counts, rates):
    w = lambda s: _RANGE.format(s)
    return f"{L} SELECT event_id, " + ", ".join(f"CAST(count(*) OVER ({w(c)}) AS BIGINT) AS req_count_{c}s" for c in counts) + (
        f", coalesce(avg(CASE WHEN status_code // 100 = 4 THEN 1.0 ELSE 0.0 END) OVER ({w(rates)}), 0) AS error_rate_4xx_{rates}s, CAST(count(DISTINCT path) OVER ({w(rates)}) AS BIGINT) AS endpoint_diversity_{rates}s FROM log_lines"
    )


@query(_temporal_sql((1, 5, 60), 60))
def temporal_seconds(spark, sf_dir):
    return temporal.temporal_features(V.log_lines(spark, sf_dir)).drop("ts", "client_ip", "path", "status_code")


@query(_temporal_sql((3600, 86400), 86400))
def temporal_days(spark, sf_dir):
    rows = temporal.temporal_features(V.log_lines(spark, sf_dir), counts=(3600, 86400), rates=86400)
    return rows.drop("ts", "client_ip", "path", "status_code")


# Features of request text


def _sql_pattern(pattern: str) -> str:
    return pattern.replace("'", "''")


def _counts_sql(column: str, named: dict[str, str]) -> str:
    return ", ".join(f"CAST(len(regexp_extract_all({column}, '{_sql_pattern(p)}')) AS INTEGER) AS {n}" for n, p in named.items())


_DOC_PATTERNS = {
    "special": P.SPECIAL_CHAR, "digits": P.NUMERIC_CHAR, "capitals": P.UPPERCASE_CHAR, "newlines": P.NEWLINE, "url_encoded": P.URL_ENCODED, "entities": P.HTML_ENTITY, "base64": P.BASE64_LIKE,
    "separators": P.PATH_SEPARATOR, "commands": P.COMMAND_SEPARATOR, "redirects": P.REDIRECT_OPERATOR, "subshells": P.SUBSHELL, "traversals": P.TRAVERSAL_SEQUENCE,
}


@query(f"SELECT doc_id, {_counts_sql('text', _DOC_PATTERNS)} FROM documents")
def text_pattern_counts(spark, sf_dir):
    d = V.load(spark, sf_dir, "documents")
    return d.select("doc_id", *[text.count(F.col("text"), p).alias(n) for n, p in _DOC_PATTERNS.items()])


@query("""WITH b AS (SELECT page_id, html, lower(hex(encode(coalesce(html, '')))) AS h FROM pages),
l AS (SELECT page_id, list_transform(range(0, len(h) // 2), lambda i: h[2 * i + 1:2 * i + 2]) AS x FROM b),
m AS (SELECT page_id, len(x) AS n, map_values(list_histogram(x)) AS c FROM l)
SELECT page_id, round(coalesce(list_sum(list_transform(c, lambda k: -(k / n) * log2(k / n + 1e-12))), 0), 8) AS entropy FROM m""")
def page_entropy(spark, sf_dir):
    return V.load(spark, sf_dir, "pages").select("page_id", F.round(text.entropy(F.coalesce("html", F.lit(""))), 8).alias("entropy"))


_QUERY_PATTERNS = {
    "operators": r"<>=?|!=|>=|<=|=+", "quotes": "['\"]", "semicolons": ";", "parentheses": "[()]", "keywords": P.SQL_KEYWORDS, "shell": P.SHELL_COMMAND, "markers": P.XSS_MARKER, "tags": P.HTML_TAG,
    "handlers": P.JS_EVENT_HANDLER, "traversals": P.TRAVERSAL_SEQUENCE, "separators": P.PATH_SEPARATOR, "extensions": P.SENSITIVE_EXTENSION, "specials": P.SPECIAL_CHAR, "dollars": r"\$", "pipes": r"\|",
}


@query(f"{R} SELECT doc_id, {_counts_sql('query', _QUERY_PATTERNS)}, CAST(regexp_matches(query, '{P.UNION}') AS INTEGER) AS union_present, CAST(regexp_matches(query, '{P.SENSITIVE_FILE}') AS INTEGER) AS sensitive FROM requests")
def query_pattern_counts(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    named = _QUERY_PATTERNS | {"operators": P.SQLI_OPERATOR}
    return r.select("doc_id", *[text.count(F.col("query"), p).alias(n) for n, p in named.items()], text.test(F.col("query"), P.UNION).alias("union_present"), text.test(F.col("query"), P.SENSITIVE_FILE).alias("sensitive"))


@query(f"""{R} SELECT doc_id, CAST(length(path || '?' || query) AS DOUBLE) AS uri_length, CAST(length(path) AS DOUBLE) AS path_length, CAST(length(query) AS DOUBLE) AS query_string_length, CAST(length(coalesce(body, '')) AS DOUBLE) AS body_length,
CAST(length(path) - length(replace(path, '/', '')) AS DOUBLE) AS path_depth, CAST(length(query) - length(replace(query, '&', '')) + 1 AS DOUBLE) AS query_param_count, CAST(contains(query, '#') AS DOUBLE) AS fragment_present,
CAST(upper(method) = 'GET' AS DOUBLE) AS method_is_get, CAST(upper(method) = 'POST' AS DOUBLE) AS method_is_post, CAST(user_agent IS NOT NULL AS DOUBLE) AS ua_present, CAST(length(coalesce(user_agent, '')) AS DOUBLE) AS ua_length,
CAST(coalesce(user_agent LIKE '%sqlmap%', false) AS DOUBLE) AS ua_suspicious, CAST(content_type LIKE '%x-www-form%' AS DOUBLE) AS content_type_encoded, 10.0::DOUBLE AS authorization_length, 1.0::DOUBLE AS unusual_headers_count, 200.0::DOUBLE AS status_code FROM requests""")
def request_lengths(spark, sf_dir):
    names = [*features.GROUPS["lengths"][2:6], *features.GROUPS["lengths"][7:], *features.GROUPS["http"]]
    return features.extract(V.requests(spark, sf_dir), ("doc_id",)).select("doc_id", *names)


@query(feature_sql.request_features_sql())
def request_features(spark, sf_dir):
    """All 76 features of every request, entropies to eight digits."""
    f = features.extract(V.requests(spark, sf_dir), ("doc_id", "label"))
    return f.withColumns({c: F.round(c, 8) for c in ("payload_entropy", "body_entropy")})


@query(f"{feature_sql.payload_ctes()} SELECT doc_id, t AS payload FROM chosen")
def request_payloads(spark, sf_dir):
    """The payload of every request: body, query or path."""
    return features.with_payload(V.requests(spark, sf_dir)).select("doc_id", "payload")


@query(f"{feature_sql.payload_ctes(V.FORMS)} SELECT doc_id, t AS payload FROM chosen")
def form_payloads(spark, sf_dir):
    """The payload of every request whose body is a form with a name, a note that may be an attack, and a text."""
    return features.with_payload(V.forms(spark, sf_dir)).select("doc_id", "payload")


@query(f"{R} SELECT doc_id, doc_id % 4 AS layers, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(body, '') || query AS t FROM requests)")
def decoded_texts(spark, sf_dir):
    """Texts in up to three layers of entities, escapes and percent escapes, decoded: they come back as they were."""
    r = V.requests(spark, sf_dir).select("doc_id", F.concat(F.coalesce("body", F.lit("")), "query").alias("t"))
    named = F.col("t")
    for character, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("a", "&#97;"), ("o", "&#X6F;"), ("e", "\\u0065")):
        named = F.replace(named, F.lit(character), F.lit(name))
    # a blank is written as an escape, since + stands for itself
    percent = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    layers = F.col("doc_id") % 4
    hidden = F.when(layers == 0, F.col("t")).when(layers == 1, named).when(layers == 2, percent(named)).otherwise(percent(percent(named)))
    return r.select("doc_id", layers.alias("layers"), text.normalise(hidden).alias("d")).select("doc_id", "layers", F.length("d").cast("long").alias("n_chars"), F.md5("d").alias("digest"))


_DECIDED = f"""WITH f AS ({feature_sql.request_features_sql()}),
m AS (SELECT doc_id, label, [1.0, shell_command_count + command_separator_count, 2 * traversal_sequence_count + 3 * sensitive_file_target, sqli_keyword_count + 3 * union_present, 3 * xss_marker_count]::DOUBLE[] AS m,
CASE WHEN special_char_ratio > 0.3 THEN 0.001 ELSE 0.1 END::DOUBLE AS if_score FROM f),
p AS (SELECT *, (['benign','cmdi','path_traversal','sqli','xss'])[list_position(m, list_max(m))] AS predicted_class, list_max(m) / (m[1] + m[2] + m[3] + m[4] + m[5]) AS confidence FROM m)
SELECT doc_id, label, CASE WHEN predicted_class <> 'benign' AND confidence >= 0.35 THEN 'block' WHEN if_score < 0.004206 THEN 'pass_anomaly' ELSE 'pass' END AS verdict, predicted_class, confidence, if_score, if_score < 0.004206 AS is_anomaly FROM p"""


@query(_DECIDED)
def request_decisions(spark, sf_dir):
    """Features turned into pseudo-probabilities by their marker counts (no model is trained here), then the policy."""
    f = features.extract(V.requests(spark, sf_dir), ("doc_id", "label"))
    marks = [F.lit(1.0), F.col("shell_command_count") + F.col("command_separator_count"), 2 * F.col("traversal_sequence_count") + 3 * F.col("sensitive_file_target"), F.col("sqli_keyword_count") + 3 * F.col("union_present"), 3 * F.col("xss_marker_count")]
    total = sum(marks[1:], marks[0])
    odd = F.when(F.col("special_char_ratio") > 0.3, 0.001).otherwise(0.1)
    return f.select("doc_id", "label", policy.decide(F.array(*[m / total for m in marks]), odd).alias("d")).select("doc_id", "label", "d.*")


# Policy, late replies, canary


@query(f"""{D} SELECT event_id, CASE WHEN k = 0 THEN 'timeout' WHEN c <> 'benign' AND p >= 0.35 THEN 'block' WHEN if_score < 0.004206 THEN 'pass_anomaly' ELSE 'pass' END AS verdict, CASE WHEN k = 0 THEN 'benign' ELSE c END AS predicted_class,
CASE WHEN k = 0 THEN 0.0 ELSE p END AS confidence, CASE WHEN k = 0 THEN 0.0 ELSE if_score END AS if_score, k <> 0 AND if_score < 0.004206 AS is_anomaly
FROM (SELECT event_id, event_id % 19 AS k, if_score, (['benign','cmdi','path_traversal','sqli','xss'])[event_id % 5 + 1] AS c, (20 + event_id % 60) / 100 AS p FROM detections)""")
def policy_verdicts(spark, sf_dir):
    e = V.detections(spark, sf_dir)
    p = (20 + F.col("event_id") % 60) / 100
    probabilities = F.when(F.col("event_id") % 19 != 0, F.array(*[F.when(F.col("event_id") % 5 == i, p).otherwise(p / 5) for i in range(5)]))
    return e.select("event_id", policy.decide(probabilities, F.col("if_score")).alias("d")).select("event_id", "d.*")


@query(f"""{D}, r AS (SELECT event_id, (event_id % 80) AS delay, 0.001 * (event_id % 9) AS late FROM detections WHERE event_id % 3 = 0)
SELECT d.event_id, CASE WHEN hit AND late < 0.004206 AND verdict = 'pass' THEN 'pass_anomaly' ELSE verdict END AS verdict, CASE WHEN hit THEN late ELSE if_score END AS if_score, hit AND late < 0.004206 AS is_anomaly, hit AS patched
FROM (SELECT d.*, r.late, coalesce(r.delay <= 50 AND verdict <> 'timeout', false) AS hit FROM detections d LEFT JOIN r USING (event_id)) d""")
def late_patches(spark, sf_dir):
    e = V.detections(spark, sf_dir).select("event_id", "timestamp", "verdict", "if_score")
    replies = e.where("event_id % 3 = 0").select("event_id", (F.col("timestamp") + F.col("event_id") % 80).alias("replied_at"), (F.lit(0.001) * (F.col("event_id") % 9)).alias("if_score"))
    return policy.patch_late(e, replies).drop("timestamp").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))


@query(f"""{D}, c AS (SELECT verdict = 'block' AS b, (['benign','cmdi','path_traversal','sqli','xss'])[event_id % 4 + 1] <> 'benign' AND (event_id % 10) / 10 >= 0.35 AS k FROM detections)
SELECT {BIG} AS total, CAST(count(*) FILTER (b = k) AS BIGINT) AS matches, count(*) FILTER (b = k) / count(*) AS rate FROM c""")
def canary_agreement(spark, sf_dir):
    e = V.detections(spark, sf_dir)
    p = (F.col("event_id") % 10) / 10
    # the class asked for has the largest probability even where that is 0
    canary = e.select("event_id", F.array(*[F.when(F.col("event_id") % 4 == i, p).otherwise(-1.0) for i in range(5)]).alias("probabilities"))
    return reports.canary_agreement(policy.compare_canary(e, canary))


# Corpus


@query(f"{R} SELECT doc_id, sha256(path || '|' || query || '|' || coalesce(body, '') || '|' || label) AS fingerprint FROM requests")
def fingerprints(spark, sf_dir):
    return V.requests(spark, sf_dir).select("doc_id", corpus.fingerprint("path", "query", "body", "label").alias("fingerprint"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    d = V.load(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.keep_first(d, F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id")


@query("""WITH k AS (SELECT source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS i FROM documents)
SELECT source, CAST(count(*) FILTER (i > 1) AS BIGINT) AS duplicates FROM k GROUP BY 1""")
def duplicates_by_source(spark, sf_dir):
    d = V.load(spark, sf_dir, "documents")
    return corpus.duplicates_by_source(d, F.sha2(F.coalesce("text", F.lit("")), 256), "source", "source", "doc_id")


@query("SELECT min(page_id) AS page_id, shape FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[A-Z]{6}', 'CANARY', 'g'), '[0-9]+', 'N', 'g') AS shape FROM pages) GROUP BY shape")
def template_dedup(spark, sf_dir):
    p = V.load(spark, sf_dir, "pages").select("page_id", corpus.template_shape(F.col("url")).alias("shape"))
    return corpus.keep_first(p, F.col("shape"), "page_id")


@query("""WITH c AS (SELECT c_mktsegment AS label, c_name || ' ' || c_nationkey AS t, min(c_custkey) AS id FROM customer GROUP BY 1, 2)
SELECT a.label, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(levenshtein(a.t, b.t) AS INTEGER) AS distance FROM c a JOIN c b ON a.label = b.label AND a.id < b.id AND abs(length(a.t) - length(b.t)) <= 2 WHERE levenshtein(a.t, b.t) <= 2""")
def near_names(spark, sf_dir):
    c = V.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string")).alias("t"))
    return corpus.near_queries(c, id_col="c_custkey", label="c_mktsegment", text="t", most=2)


_SPLIT = f"""{R}, o AS (SELECT doc_id, label, _source, row_number() OVER (PARTITION BY label, _source ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY label, _source) AS n FROM requests),
split AS (SELECT doc_id, label, _source, CASE WHEN i <= ceil(n * 0.15::DOUBLE) THEN 'test' WHEN i <= ceil(n * (0.15::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM o)"""


def _split(spark, sf_dir):
    return corpus.stratified_split(V.requests(spark, sf_dir).select("doc_id", "label", "_source"), id_col="doc_id")


@query(f"{_SPLIT} SELECT doc_id, label, _source, split FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"""{_SPLIT}, t AS (SELECT label, count(*) / (SELECT count(*) FROM split) AS overall FROM split GROUP BY 1), p AS (SELECT split, label, count(*) AS n FROM split GROUP BY 1, 2)
SELECT split, label, round(n / sum(n) OVER (PARTITION BY split), 8) AS share, round(overall, 8) AS overall, abs(n / sum(n) OVER (PARTITION BY split) - overall) <= 0.02 AS within FROM p JOIN t USING (label)""")
def split_drift(spark, sf_dir):
    return corpus.split_drift(_split(spark, sf_dir), "label").withColumns({c: F.round(c, 8) for c in ("share", "overall")})


@query(f"{_SPLIT}, h AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS h FROM split WHERE split = 'test') SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS lock, {BIG} AS rows FROM h")
def lock_hash(spark, sf_dir):
    test = _split(spark, sf_dir).where("split = 'test'").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return corpus.lock_hash(test, "h")


@query(f"""WITH p AS (SELECT DISTINCT 'all' AS label, text AS payload FROM benchmark WHERE length(text) > 0)
SELECT label, {BIG} AS total, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, p.payload))) AS BIGINT) AS matches FROM p GROUP BY 1""")
def leakage(spark, sf_dir):
    rows = V.load(spark, sf_dir, "documents").select(F.lit("all").alias("label"), "text")
    payloads = V.load(spark, sf_dir, "benchmark").select(F.lit("all").alias("label"), F.col("text").alias("payload"))
    return leaks.containment(rows, payloads, fields=("text",))


@query(f"{R} SELECT _source, label, {BIG} AS n, round(count(*) / (SELECT count(*) FROM requests), 8) AS share FROM requests GROUP BY 1, 2")
def source_distribution(spark, sf_dir):
    return corpus.distribution(V.requests(spark, sf_dir), "_source", "label").withColumn("share", F.round("share", 8))


_CLASSES = ["benign", "cmdi", "path_traversal", "sqli", "xss"]
_FILTERS = [f"count(*) FILTER (label = '{c}')" for c in _CLASSES]


@query(f"{R} SELECT _source, " + ", ".join(f"CAST({f} AS BIGINT) AS {c}" for f, c in zip(_FILTERS, _CLASSES, strict=True)) + f", {BIG} AS total, greatest({', '.join(_FILTERS)}) / greatest(least({', '.join(_FILTERS)}), 1) AS ratio FROM requests GROUP BY 1")
def coverage(spark, sf_dir):
    return corpus.coverage(V.requests(spark, sf_dir), "_source", "label", _CLASSES)


@query(f"""SELECT event_type, CAST(count(value) AS BIGINT) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max FROM events GROUP BY 1""")
def describe_events(spark, sf_dir):
    return corpus.describe_by(V.load(spark, sf_dir, "events"), "event_type", "value").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query(f"{R} SELECT * FROM (SELECT 'user_agent' AS \"column\", CAST(count(*) FILTER (user_agent IS NULL) AS BIGINT) AS nulls, 100 * count(*) FILTER (user_agent IS NULL) / count(*) AS percent FROM requests UNION ALL SELECT 'body', CAST(count(*) FILTER (body IS NULL) AS BIGINT), 100 * count(*) FILTER (body IS NULL) / count(*) FROM requests)")
def null_counts(spark, sf_dir):
    return corpus.null_counts(V.requests(spark, sf_dir).select("user_agent", "body"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicates, 100 * (count(*) - count(DISTINCT text)) / count(*) AS percent FROM documents")
def duplicate_rate(spark, sf_dir):
    return corpus.duplicate_rate(V.load(spark, sf_dir, "documents"), "text")


@query("WITH o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id FROM o WHERE i IN (SELECT floor(k * n / 70.0) FROM range(70) t(k), (SELECT max(n) AS n FROM o))")
def every_nth(spark, sf_dir):
    return corpus.every_nth(V.load(spark, sf_dir, "events").select("event_id"), 70, "event_id")


# Evaluation

_EVAL = "WITH e AS (SELECT l.doc_id, l.toxic AS y, CASE WHEN contains(d.text, 'idiot') OR contains(d.text, 'stupid') OR contains(d.text, 'trash') THEN 1 ELSE 0 END AS p, CAST(length(d.text) % 1000 AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))"


def _eval(spark, sf_dir):
    d = V.load(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.col("text").contains("idiot") | F.col("text").contains("stupid") | F.col("text").contains("trash")
    return V.load(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("toxic").alias("y"), hit.cast("int").alias("p"), (F.length("text") % 1000).cast("double").alias("score"))


@query(f"{_EVAL} SELECT y, p, {BIG} AS n FROM e GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_eval(spark, sf_dir))


@query(f"""{_EVAL}, c AS (SELECT k AS label, count(*) FILTER (y = k AND p = k) AS hit, count(*) FILTER (p = k) AS said, count(*) FILTER (y = k) AS support FROM e, (VALUES (0), (1)) v(k) GROUP BY 1),
r AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re FROM c)
SELECT label, pr AS precision, re AS recall, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1, CAST(support AS BIGINT) AS support FROM r""")
def class_report(spark, sf_dir):
    return metrics.class_report(_eval(spark, sf_dir))


@query(f"""{_EVAL}, a AS (SELECT sum(CASE WHEN x.score > z.score THEN 1.0 WHEN x.score = z.score THEN 0.5 ELSE 0 END) AS w FROM e x JOIN e z ON x.y = 1 AND z.y = 0)
SELECT round(w / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS auc, CAST(count(*) FILTER (y = 1) AS BIGINT) AS positives, CAST(count(*) FILTER (y = 0) AS BIGINT) AS negatives FROM e, a GROUP BY w""")
def auc(spark, sf_dir):
    return metrics.auc(_eval(spark, sf_dir)).withColumn("auc", F.round("auc", 8))


@query(f"""{_EVAL}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn FROM e)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, tp / (tp + fn) AS recall, fp / (fp + tn) AS fp_rate FROM c""")
def binary_rates(spark, sf_dir):
    return metrics.binary_rates(_eval(spark, sf_dir))


@query(f"""{_EVAL}, b AS (SELECT min(score) AS low, max(score) AS high FROM e), t AS (SELECT CAST(i AS INTEGER) AS point, low + i * ((high - low) / 299) AS threshold, (high - low) / 299 AS step, low FROM range(300) r(i), b),
q AS (SELECT y, greatest(0, least(300, floor((score - b.low) / ((b.high - b.low) / 299)) + 1)) AS k FROM e, b)
SELECT point, threshold, count(*) FILTER (y = 1 AND k <= point) / count(*) FILTER (y = 1) AS recall, count(*) FILTER (y = 0 AND k <= point) / count(*) FILTER (y = 0) AS fp_rate FROM t, q GROUP BY 1, 2""")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_eval(spark, sf_dir))


# Telemetry, anomalies


def _telemetry(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings")
    classes = F.array(*[F.lit(c) for c in (*policy.CLASSES, "unknown")])
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.element_at(classes, (F.col("vec_id") % 6 + 1).cast("int")).alias("predicted_class"),
        ((F.col("vec_id") % 12) / 10).alias("confidence"), (F.col("vec_id") % 9).alias("timestamp"), F.when(F.col("vec_id") % 4 == 0, "").otherwise(F.concat(F.lit("host"), (F.col("vec_id") % 4).cast("string"))).alias("source_id"), "label",
    )


@query(f"""SELECT CASE WHEN vec_id % 6 = 5 THEN 'predicted_class must be one of benign, cmdi, path_traversal, sqli, xss' WHEN vec_id % 12 > 10 THEN 'confidence must be a number in [0, 1]' WHEN vec_id % 9 = 0 THEN 'timestamp must be a positive number'
WHEN vec_id % 4 = 0 THEN 'source_id must be a non-empty string up to 128 characters' ELSE 'valid' END AS reason, {BIG} AS n FROM embeddings GROUP BY 1""")
def telemetry_reasons(spark, sf_dir):
    return validate.reason_counts(_telemetry(spark, sf_dir), validate.telemetry_error(64))


@query()
def isolation_scores(spark, sf_dir):
    """Anomaly scores of the vectors by all components, by a forest of the published size trained on them."""
    e = V.load(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(64)]
    d = e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    forest = models.IsolationForest(names).fit(d, "vec_id")
    return forest.transform(d, ("vec_id",))




@query("SELECT vec_id, round((f0 - avg(f0) OVER ()) / stddev_pop(f0) OVER (), 6) AS f0, round((f1 - avg(f1) OVER ()) / stddev_pop(f1) OVER (), 6) AS f1 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1 FROM embeddings)")
def standardised(spark, sf_dir):
    e = V.load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("f0"), F.col("embedding")[1].cast("double").alias("f1"))
    return metrics.standardise(e, ["f0", "f1"]).withColumns({c: F.round(c, 6) for c in ("f0", "f1")})


_POINTS = "p AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) * 40 AS y FROM customer)"
_NEAR = "n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 60)"


@query(f"""WITH RECURSIVE {_POINTS}, {_NEAR}, c AS (SELECT a AS id FROM n GROUP BY a HAVING count(*) + 1 >= 4), l AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM c) AND b IN (SELECT id FROM c)),
r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a), g AS (SELECT id, min(reach) AS cluster FROM r GROUP BY id), o AS (SELECT n.a AS id, min(g.cluster) AS cluster FROM n JOIN g ON n.b = g.id GROUP BY 1)
SELECT p.id, coalesce(g.cluster, o.cluster) AS cluster FROM p LEFT JOIN g ON p.id = g.id LEFT JOIN o ON p.id = o.id""")
def density_clusters(spark, sf_dir):
    c = V.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double") * 40).alias("v"))
    return cluster.dbscan(c, eps=60.0, min_samples=4)
