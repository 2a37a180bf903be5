"""Request sources: each reader returns canonical request columns as a DataFrame, lazily.

Files are read by Spark's own readers from any store it knows; nothing opens a
path on the driver. Rows that cannot be read are dropped or counted, never fatal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.functions.text import decode_form, unescape
from weir.operators.corpus import keep_first, template_shape
from weir.operators.places import materialise, numbered
from weir.sources import labels as known_labels

#: Columns of a canonical request line.
REQUEST_SCHEMA = (
    "sample_id string, label string, timestamp string, _source string, _row_hash string, method string, path string, query string, body string, "
    "userAgent string, contentType string, referer string, cookie string, extraHeaders map<string,string>, statusCode int"
)
#: Which class wins where a record has several labels.
PRIORITY = ("sqli", "path_traversal", "cmdi", "xss")


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Canonical requests of JSON lines; `_bad` has the text of lines that are no JSON object, else null."""
    d = spark.read.schema(REQUEST_SCHEMA + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.withColumnsRenamed({"userAgent": "user_agent", "contentType": "content_type", "extraHeaders": "extra_headers", "statusCode": "status_code"})


def read_corpus(spark: SparkSession, folder: str, exclude: str = r"^(unified|telemetry_curated_.*)$") -> DataFrame:
    """All JSON lines of a folder with `_source`, the file's name without ending."""
    d = read_jsonl(spark, f"{folder}/*.jsonl").withColumn("_source", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    return d.where(~F.col("_source").rlike(exclude) & F.col("_bad").isNull()).drop("_bad")


def split_url(url: Column) -> Column:
    """struct(path, query): scheme and host go, markup line breaks too; cut at the first question mark."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)<br\\s*/?>", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    at = F.instr(rest, "?")
    return F.struct(F.when(at > 0, rest.substr(F.lit(1), at - 1)).otherwise(rest).alias("path"), F.when(at > 0, rest.substr(at + 1, F.length(rest))).otherwise("").alias("query"))


def as_query(payload: Column, label: Column, source: str) -> list[Column]:
    return [F.lit("GET").alias("method"), F.lit("/").alias("path"), payload.alias("query"), F.lit("").alias("body"), label.alias("label"), F.lit(source).alias("_source")]


def map_labels(d: DataFrame, raw: str, labels: dict[str, str]) -> DataFrame:
    """`label` from a raw label column by a small map; rows with other labels are dropped."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return d.withColumn("label", F.try_element_at(known, F.trim(F.col(raw)))).where(F.col("label").isNotNull())


def labelled_payloads(d: DataFrame, *, payload: str, label: str, labels: dict[str, str], source: str, decode: bool = False, fold: bool = False) -> DataFrame:
    """Payload rows as requests: blank payloads and unknown labels are dropped, payloads trimmed.

    `decode` resolves character references, `fold` ignores the case of raw labels.
    """
    raw = F.lower(F.col(label)) if fold else F.col(label)
    text = F.trim(F.col(payload).cast("string"))
    d = map_labels(d.withColumn("_raw", raw.cast("string")), "_raw", labels).where(F.length(text) > 0)
    return d.select(*as_query(unescape(text) if decode else text, F.col("label"), source))


def read_payload_csv(spark: SparkSession, path: str, *, payload: str, label: str, labels: dict[str, str], source: str, encoding: str = "UTF-8", **options) -> DataFrame:
    """Payloads with a label column; see `labelled_payloads`."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    return labelled_payloads(d, payload=payload, label=label, labels=labels, source=source, **options)


def read_named(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A data set by its name, with its own columns and labels: payload_full, xss_dataset, command_injection, payloads_csv or modsec_learn."""
    table = known_labels.LABELS[source]
    one = lambda payload, label, **more: read_payload_csv(spark, path, payload=payload, label=label, labels=table, source=source, **more)
    if source == "payload_full":
        return one("payload", "attack_type", fold=True)
    if source == "xss_dataset":
        return one("Sentence", "Label").select("method", "path", F.col("body").alias("query"), F.col("query").alias("body"), "label", "_source")
    if source == "command_injection":
        return one("sentence", "Label", decode=True)
    if source == "payloads_csv":
        d = one("Payloads", "Class", encoding="ISO-8859-1").withColumn("_u", split_url(F.col("query")))
        return d.select("method", F.trim("_u.path").alias("path"), F.trim("_u.query").alias("query"), "body", "label", "_source")
    if source == "modsec_learn":
        stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]*$", 1)
        d = spark.read.text(path, wholetext=True).select(stem.alias("_stem"), F.explode(F.from_json("value", "array<string>")).alias("q"))
        return map_labels(d.where(F.length("q") > 0), "_stem", table).select(*as_query(F.col("q"), F.col("label"), source))
    raise ValueError(f"no columns are known for {source}")


def curated_payloads(spark: SparkSession) -> DataFrame:
    """The curated list of command injections as requests."""
    d = spark.createDataFrame([(i, p) for i, p in enumerate(known_labels.CURATED)], "line int, payload string")
    return d.select("line", *as_query(F.col("payload"), F.lit("cmdi"), "patt_cmdi_curated"))


def priority_label(flags: dict[str, Column], default: str | None = None, order: tuple[str, ...] = PRIORITY) -> Column:
    """The first class of the order whose flag is set."""
    return F.coalesce(*[F.when(flags[c], c) for c in order if c in flags], F.lit(default))


def read_multilabel_csv(spark: SparkSession, path: str, flags: dict[str, list[str]] | None = None, source: str = "capec", default: str | None = None, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Request columns with 0/1 label columns; header columns that are not empty become extra headers.

    A row has the first class of the order one of whose columns is 1; rows
    without any are dropped, or have the default. Without `flags` the columns
    of the known multi-label file are taken.
    """
    flags = known_labels.MULTILABEL if flags is None else flags
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return multilabel_requests(d, flags, source, default, order)


def multilabel_requests(d: DataFrame, flags: dict[str, list[str]], source: str, default: str | None = None, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    hit = {c: F.greatest(*[F.coalesce(F.try_to_number(F.col(f"`{x}`").cast("string"), F.lit("9")).cast("int"), F.lit(0)) if x in d.columns else F.lit(0) for x in columns], F.lit(0)) == 1 for c, columns in flags.items()}
    have = lambda *names: F.coalesce(*[F.when(F.length(F.col(c)) > 0, F.col(c)) for c in names if c in d.columns], F.lit(""))
    names = {c: h for c, h in known_labels.MULTILABEL_HEADERS.items() if c in d.columns} | {c: c.removeprefix("request_header_").lower() for c in d.columns if c.startswith("request_header_")}
    extra = F.create_map(*[x for c, h in names.items() for x in (F.lit(h), F.col(c))]) if names else F.create_map().cast("map<string,string>")
    url = split_url(have("request_http_request", "request_url"))
    method = F.upper(F.trim(have("request_http_method", "request_method")))
    out = d.select(
        F.when(method == "", "GET").otherwise(method).alias("method"), url["path"].alias("path"), url["query"].alias("query"), F.trim(have("request_body")).alias("body"),
        have("request_user_agent").alias("user_agent"), have("request_content_type").alias("content_type"), have("request_referer").alias("referer"), have("request_cookie").alias("cookie"),
        F.map_filter(extra, lambda _, v: v.isNotNull() & (v != "")).alias("extra_headers"), priority_label(hit, default, order).alias("label"), F.lit(source).alias("_source"),
    )
    return out.where(F.col("label").isNotNull())


def read_json_strings(spark: SparkSession, path: str, label: str, source: str) -> DataFrame:
    """A file that is one JSON array of payloads."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("q"))
    return d.where(F.length("q") > 0).select(*as_query(F.col("q"), F.lit(label), source))


def audit_blocks(spark: SparkSession, path: str) -> DataFrame:
    """ModSecurity audit log: one row per transaction, `sections` maps section letters to their text.

    Records end with a Z boundary, so that large files are read in splits.
    """
    # the separator ends before the line's own end, which may be \r\n
    text = spark.read.text(path, lineSep="-Z--").withColumn("value", F.regexp_replace(F.regexp_replace("value", r"\r\n", "\n"), r"\n--[0-9a-fA-F]+$", ""))
    # a transaction starts at its A boundary
    block = text.select(F.explode(F.split("value", r"(?m)^(?=--[0-9a-fA-F]+-A--\s*$)")).alias("b")).where("b rlike '^--[0-9a-fA-F]+-A--'")
    parts = F.filter(F.split("b", r"(?m)^(?=--[0-9a-fA-F]+-[A-Z]--\s*$)"), lambda x: x.rlike("^--[0-9a-fA-F]+-[A-Z]--"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^--[0-9a-fA-F]+-([A-Z])--", 1).alias("k"), F.btrim(F.regexp_replace(x, r"^--[0-9a-fA-F]+-[A-Z]--[^\n]*\n?", ""), F.lit(" \t\r\n")).alias("v"))
    pairs = F.transform(parts, entry)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))
    return block.select(F.regexp_extract("b", "^--([0-9a-fA-F]+)-A--", 1).alias("id"), F.map_from_entries(last).alias("sections"))


def message_label(messages: Column) -> Column:
    """The first class that the messages name; benign without any message, null for other messages."""
    text = F.upper(F.coalesce(messages, F.lit("")))
    named = priority_label({c: reduce(lambda a, b: a | b, [text.contains(p.upper()) for p in patterns]) for c, patterns in known_labels.MESSAGE_PATTERNS.items()})
    return F.when(~F.coalesce(messages.contains("Message:"), F.lit(False)), "benign").otherwise(named)


def tag_label(messages: Column) -> Column:
    """The class that tags and rule ids of the messages name, null if none: the older reading of audit logs."""
    tags, rules = tags_of(messages), tags_of(messages, "id")
    hit = lambda have, wanted: F.arrays_overlap(have, F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(False)
    return F.coalesce(*[F.when(hit(tags, t) | hit(rules, r), c) for c, t, r in known_labels.TAG_CLASSES])


def tags_of(messages: Column, kind: str = "tag") -> Column:
    """The distinct [tag "..."] or [id "..."] values of the messages."""
    return F.array_distinct(F.regexp_extract_all(messages, F.lit(rf'\[{kind} "([^"]*)"\]'), F.lit(1)))


def headers_of(text: Column) -> Column:
    """Header lines as a map with lower-case names; the last of a name counts."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(x.substr(F.instr(x, ":") + 1, F.length(x))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


#: Headers that have a column of their own.
OWN_HEADERS = {"user-agent": "user_agent", "content-type": "content_type", "referer": "referer", "cookie": "cookie"}


def read_audit(spark: SparkSession, path: str, source: str = "audit") -> DataFrame:
    """Requests of an audit log with labels from their messages; unclear ones are dropped.

    The body is what follows a blank line in section B, else section C.
    """
    s = lambda k: F.coalesce(F.try_element_at("sections", F.lit(k)), F.lit(""))
    line = F.regexp_extract(s("B"), r"^(\S+ \S+)", 1)
    url = split_url(F.substring_index(line, " ", -1))
    head, rest = F.regexp_extract(s("B"), r"^[^\n]*\n((?:[^\r\n]+\r?(?:\n|$))*)", 1), F.regexp_extract(s("B"), r"(?s)\r?\n\r?\n(.*)$", 1)
    headers = headers_of(head)
    status = F.regexp_extract(s("F"), r"^HTTP/\S+\s+(\d{3})", 1)
    own = [F.coalesce(F.try_element_at("_headers", F.lit(h)), F.lit("")).alias(c) for h, c in OWN_HEADERS.items()]
    out = audit_blocks(spark, path).select(
        "id", F.substring_index(line, " ", 1).alias("method"), url["path"].alias("path"), url["query"].alias("query"), F.when(F.length(rest) > 0, rest).otherwise(s("C")).alias("body"), headers.alias("_headers"),
        F.when(status != "", status.cast("int")).otherwise(0).alias("status_code"), message_label(s("H")).alias("label"), F.lit(source).alias("_source"),
    )
    out = out.where(F.col("label").isNotNull() & (F.col("method") != ""))
    return out.select("id", "method", "path", "query", "body", F.map_filter("_headers", lambda k, _: ~k.isin(*OWN_HEADERS)).alias("extra_headers"), *own, "status_code", "label", "_source")


#: Fixed value: the common log format.
CLF = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (?:\d+|-)(?: "[^"]*" "([^"]*)")?'


def access_lines(d: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """client_ip, ts, method, path, query, status_code, user_agent of the matching lines of `d` (value, file, line).

    `labelled` has file and line, the number from 1, of lines to leave out;
    equal lines elsewhere stay.
    """
    d = d.where(F.col("value").rlike(CLF))
    if labelled is not None:
        d = d.join(labelled.select("file", F.col("line").cast("bigint").alias("line")), ["file", "line"], "left_anti")
    g = lambda i: F.regexp_extract("value", CLF, i)
    url = split_url(g(4))
    known = [g(1).alias("client_ip"), F.try_to_timestamp(F.substring_index(g(2), " ", 1), F.lit("dd/MMM/yyyy:HH:mm:ss")).alias("ts"), g(3).alias("method"), url["path"].alias("path"), url["query"].alias("query"), g(5).cast("int").alias("status_code"), g(6).alias("user_agent")]
    return d.select(*[c for c in ("file", "line") if c in d.columns], *known)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line: the lines of text files with their numbers from 1.

    A file's splits are counted first; a line's number is its place in its split
    plus the lines of the splits before. Both come from one materialised table.
    """
    at = F.col("_metadata.file_block_start")
    d = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), at.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    d = materialise(d)
    blocks = d.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = blocks.withColumn("_before", F.sum("_n").over(W.partitionBy("file").orderBy("_block")) - F.col("_n"))
    return d.join(F.broadcast(before), ["file", "_block"]).select("value", "file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"))


def read_access_log(spark: SparkSession, path: str, labelled: DataFrame | None = None) -> DataFrame:
    """Requests of access logs; `labelled` has file (its name) and line of those to leave out."""
    if labelled is None:
        return access_lines(spark.read.text(path))
    return access_lines(numbered_lines(spark, path), labelled).drop("file", "line")


def read_wordlist(spark: SparkSession, path: str, label: str, source: str) -> DataFrame:
    """One path per line, percent-decoded; blank lines are skipped."""
    line = F.trim("value")
    d = spark.read.text(path).where(F.length(line) > 0)
    return d.select(F.lit("GET").alias("method"), decode_form(F.replace(line, F.lit("+"), F.lit("%2B"))).alias("path"), F.lit("").alias("query"), F.lit("").alias("body"), F.lit(label).alias("label"), F.lit(source).alias("_source"))


def read_templated(spark: SparkSession, path: str, label: str, source: str) -> DataFrame:
    """A list of generated payloads, of each template its first line."""
    d = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.monotonically_increasing_id().alias("line"))
    return keep_first(d, template_shape(F.col("value")), "line").select(*as_query(F.col("value"), F.lit(label), source))


def synthetic_benign(spark: SparkSession, n: int, persona: str = "dashboard", seed: int = 42) -> DataFrame:
    """Seeded benign requests of a persona; every row follows from its number alone."""
    paths = {"dashboard": ("/dashboard", "/reports/daily", "/users/profile", "/search"), "api_only": ("/api/v1/items", "/api/v1/orders", "/api/v1/health"), "admin_panel": ("/admin/users", "/admin/settings", "/admin/audit")}[persona]
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m)).cast("int")
    d = spark.range(n)
    return d.select(
        F.concat(F.lit(f"{persona}-"), F.col("id").cast("string")).alias("sample_id"), F.when(draw("m", 4) == 0, "POST").otherwise("GET").alias("method"), F.element_at(F.array(*[F.lit(p) for p in paths]), draw("p", len(paths)) + 1).alias("path"),
        F.concat(F.lit("page="), draw("q", 50).cast("string"), F.lit("&sort="), F.when(draw("s", 2) == 0, "name").otherwise("date")).alias("query"), F.lit("").alias("body"), F.lit("Mozilla/5.0").alias("user_agent"), F.lit("benign").alias("label"), F.lit(f"synthetic_{persona}").alias("_source"),
    )


def over_hosts(requests: DataFrame, hosts: int, *order) -> DataFrame:
    """Requests dealt to hosts in turn, by their place in the order."""
    return numbered(requests, *order, name="host", first=0).withColumn("host", F.pmod("host", F.lit(hosts)).cast("int"))
