import datetime
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.sources import readers, sinks
from weir.streaming import live, telemetry

AUDIT = """--a1b2-A--
[01/Jan/2024:00:00:00 +0000] id 1.2.3.4
--a1b2-B--
GET /x?id=1 HTTP/1.1
Host: h:80
User-Agent: sqlmap/1.0

--a1b2-F--
HTTP/1.1 403 Forbidden
--a1b2-H--
Message: Warning. SQL Injection Attack [id "942100"] [tag "attack-sqli"]
--a1b2-Z--

--c3d4-A--
[01/Jan/2024:00:00:01 +0000] id 1.2.3.4
--c3d4-B--
POST /form HTTP/1.1

--c3d4-C--
a=1
--c3d4-H--
Apache-Handler: x
--c3d4-Z--
"""


def test_jsonl(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"path": "/a", "query": "q"}\n\nnot json\n{"path": "/b", "statusCode": 404}\n')
    (tmp_path / "unified.jsonl").write_text('{"path": "/c"}\n')
    rows = readers.read_corpus(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r.path, r._source, r.status_code) for r in rows] == [("/a", "one", None), ("/b", "one", 404)]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text('payload,kind\n"a ""quoted"" x",SQLi\n  ,SQLi\nb,other\n')
    r = readers.read_payload_csv(spark, str(tmp_path / "p.csv"), payload="payload", label="kind", labels={"SQLi": "sqli"}, source="s").collect()
    assert [(x.query, x.label) for x in r] == [('a "quoted" x', "sqli")]
    (tmp_path / "m.csv").write_text("request_method,request_url,request_body,request_header_host,66,79\nGET,http://h/p?q=1,,h,1,1\nGET,/none,,,0,0\n")
    r = readers.read_multilabel_csv(spark, str(tmp_path / "m.csv"), {"sqli": ["66"], "xss": ["79"]}, "capec").collect()
    assert [(x.path, x.query, x.label, x.extra_headers) for x in r] == [("/p", "q=1", "sqli", {"host": "h"})]


def test_other_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(["x", "", "y"]))
    assert [r.query for r in readers.read_json_strings(spark, str(tmp_path / "a.json"), "xss", "s").collect()] == ["x", "y"]
    (tmp_path / "w.txt").write_text("/a%20b\n\n/c\n")
    assert [r.path for r in readers.read_wordlist(spark, str(tmp_path / "w.txt"), "path_traversal", "s").collect()] == ["/a b", "/c"]
    (tmp_path / "t.txt").write_text("echo ABCDEF 1\necho QWERTY 22\nls\n")
    assert sorted(r.query for r in readers.read_templated(spark, str(tmp_path / "t.txt"), "cmdi", "s").collect()) == ["echo ABCDEF 1", "ls"]


def test_audit_log(spark, tmp_path):
    (tmp_path / "audit.log").write_text(AUDIT)
    rows = readers.read_audit(spark, str(tmp_path / "audit.log")).orderBy("id").collect()
    assert [(r.id, r.method, r.path, r.query, r.body, r.label, r.status_code) for r in rows] == [("a1b2", "GET", "/x", "id=1", "", "sqli", 403), ("c3d4", "POST", "/form", "", "a=1", "benign", 0)]
    assert (rows[0].user_agent, rows[0].content_type, rows[0].extra_headers) == ("sqlmap/1.0", "", {"host": "h:80"})
    (tmp_path / "two.log").write_text(AUDIT.replace("POST /form HTTP/1.1\n", "POST /form HTTP/1.1\nA: b:c\n\nx=1: 2\ny=3"))
    two = readers.read_audit(spark, str(tmp_path / "two.log")).where("id = 'c3d4'").first()
    assert (two.body, two.extra_headers) == ("x=1: 2\ny=3", {"a": "b:c"})
    h = readers.audit_blocks(spark, str(tmp_path / "audit.log")).select(readers.tags_of(F.col("sections")["H"]), readers.tags_of(F.col("sections")["H"], "id")).first()
    assert (h[0], h[1]) == (["attack-sqli"], ["942100"])


def test_audit_log_with_long_line_ends(spark, tmp_path):
    (tmp_path / "crlf.log").write_bytes(AUDIT.replace("\n", "\r\n").encode())
    rows = readers.read_audit(spark, str(tmp_path / "crlf.log")).orderBy("id").collect()
    assert [(r.id, r.path, r.body, r.label, r.status_code) for r in rows] == [("a1b2", "/x", "", "sqli", 403), ("c3d4", "/form", "a=1", "benign", 0)]


def test_line_numbers_over_splits(spark, tmp_path):
    # labelled lines go by number: equal lines elsewhere stay, over several splits of a file
    line = '1.2.3.4 - - [02/Jan/2024:03:04:05 +0000] "GET /a HTTP/1.1" 200 12 "-" "curl/8"'
    (tmp_path / "big.log").write_text("".join(f"{line}\n" if i % 7 else f"{line.replace('/a', f'/n{i}')}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = {r.line: r.value for r in readers.numbered_lines(spark, str(tmp_path / "big.log")).collect()}
        labelled = spark.createDataFrame([("big.log", 7), ("big.log", 8), ("big.log", 2996)], "file string, line long")
        left = readers.read_access_log(spark, str(tmp_path / "big.log"), labelled).select("path").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(numbered) == 3000 and all(f"/n{i} " in numbered[i] for i in range(7, 3001, 7))
    assert len(left) == 2997 and not {"/n7", "/n2996"} & {r.path for r in left}


def test_named_sources(spark, tmp_path):
    write = lambda name, text, **kw: ((tmp_path / name).write_bytes(text.encode(kw.get("encoding", "utf-8"))), str(tmp_path / name))[1]
    r = readers.read_named(spark, write("f.csv", "payload,attack_type\n x ,SQLI\n,xss\ny,odd\n"), "payload_full").collect()
    assert [(x.query, x.label) for x in r] == [("x", "sqli")]
    r = readers.read_named(spark, write("x.csv", "Sentence,Label\n<b>,1\nhello,0\nz,2\n"), "xss_dataset").collect()
    assert [(x.body, x.query, x.label) for x in r] == [("<b>", "", "xss"), ("hello", "", "benign")]
    r = readers.read_named(spark, write("c.csv", "sentence,Label\n&lt;a&gt; &eacute;,1\n"), "command_injection").collect()
    assert [(x.query, x.label) for x in r] == [("<a> \u00e9", "cmdi")]
    r = readers.read_named(spark, write("p.csv", "Payloads,Class\nhttp://h/\u00e9?q=<br/>1,Malicious\n", encoding="latin-1"), "payloads_csv").collect()
    assert [(x.path, x.query, x.label) for x in r] == [("/\u00e9", "q=1", "xss")]
    r = readers.read_named(spark, write("malicious_dataset.json", json.dumps(["a", "", "b"])), "modsec_learn").collect()
    assert [(x.query, x.label) for x in r] == [("a", "sqli"), ("b", "sqli")]
    with pytest.raises(ValueError):
        readers.read_named(spark, "x", "synthetic_nav")
    write("cap.csv", '"66 - SQL Injection","126 - Path Traversal",request_http_method,request_http_request,request_accept,request_user_agent\n0,1,post,/a?b=1,*/*,ua\n0,0,get,/,,\n')
    r = readers.read_multilabel_csv(spark, str(tmp_path / "cap.csv")).collect()
    assert [(x.method, x.path, x.query, x.label, x.extra_headers, x.user_agent) for x in r] == [("POST", "/a", "b=1", "path_traversal", {"accept": "*/*"}, "ua")]


def test_message_and_tag_labels(spark):
    given = ['Message: [tag "WEB_ATTACK/SQL_INJECTION"]', 'Message: [tag "web_attack/dir_traversal"]', 'Message: [tag "WEB_ATTACK/RFI"]', 'Message: [tag "WEB_ATTACK/RCE"]', 'Message: [tag "language-shell"]', "Message: sqli in a policy", "nothing", None, 'Message: [id "930130"]']
    d = spark.createDataFrame([(i, m) for i, m in enumerate(given)], "i int, m string").select("i", readers.message_label(F.col("m")).alias("a"), readers.tag_label(F.col("m")).alias("b")).orderBy("i")
    assert [r.a for r in d.collect()] == ["sqli", "path_traversal", "path_traversal", "cmdi", "cmdi", None, "benign", "benign", None]
    assert [r.b for r in d.collect()] == [None] * 8 + ["path_traversal"]


def test_access_log(spark, tmp_path):
    line = '1.2.3.4 - - [02/Jan/2024:03:04:05 +0000] "GET /a?b=c HTTP/1.1" 404 12 "-" "curl/8"'
    (tmp_path / "x.log").write_text(f"{line}\nbroken\n{line.replace('/a', '/z')}\n")
    labelled = spark.createDataFrame([("x.log", 3), ("x.log", 2), ("y.log", 1)], "file string, line long")
    r = readers.read_access_log(spark, str(tmp_path / "x.log"), labelled).collect()
    assert readers.read_access_log(spark, str(tmp_path / "x.log")).count() == 2
    assert [(x.client_ip, x.ts, x.path, x.query, x.status_code, x.user_agent) for x in r] == [("1.2.3.4", datetime.datetime(2024, 1, 2, 3, 4, 5), "/a", "b=c", 404, "curl/8")]


def test_synthetic_and_hosts(spark):
    d = readers.synthetic_benign(spark, 100, "api_only")
    assert sorted(map(repr, d.collect())) == sorted(map(repr, readers.synthetic_benign(spark, 100, "api_only").repartition(3).collect()))
    assert {r["count"] for r in readers.over_hosts(d, 4, "sample_id").groupBy("host").count().collect()} == {25}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b", c')], "x int, t string")
    sinks.write_csv(d, str(tmp_path / "c"))
    assert sinks.csv_to_parquet(spark, str(tmp_path / "c"), str(tmp_path / "p"), "x int, t string") == 1
    assert spark.read.parquet(str(tmp_path / "p")).first().t == 'a "b", c'
    for v in (1, 2):
        sinks.append_events(spark.createDataFrame([(7, v, f"v{v}")], "event_id long, version int, verdict string"), str(tmp_path / "log"))
    assert sinks.latest_events(spark.read.parquet(str(tmp_path / "log"))).first().verdict == "v2"


def stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    live.drain(q)
    return df.sparkSession.table(name)


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_streamed_scoring(spark, tmp_path):
    s = stream(spark, tmp_path, "r", [(1, "GET", "/", "' UNION SELECT 1 FROM t"), (2, "GET", "/", "page=2")], "id long, method string, path string, query string")
    hit = lambda f: F.array(F.lit(0.4), F.lit(0.0), F.lit(0.0), F.when(F.col("union_present") > 0, 0.9).otherwise(0.0), F.lit(0.0))
    assert {(r.id, r.verdict) for r in run(live.scored(s, hit, ("id",)), "scored").collect()} == {(1, "block"), (2, "pass")}


def test_streamed_replies(spark, tmp_path):
    a = stream(spark, tmp_path, "a", [(1, at(0)), (2, at(0)), (3, at(100))], "id long, ts timestamp")
    b = stream(spark, tmp_path, "b", [(1, at(0.01), [1.0]), (2, at(0.2), [1.0]), (9, at(100), [1.0])], "id long, replied_at timestamp, probabilities array<double>")
    got = {(r.id, r.probabilities is not None) for r in run(live.with_replies(a, b), "replies").collect()}
    assert (1, True) in got and (2, True) not in got


def test_streamed_canary(spark, tmp_path):
    e = stream(spark, tmp_path, "e", [(1, at(0), "block", 0.9), (2, at(0), "pass", 0.1)], "event_id long, ts timestamp, verdict string, confidence double")
    c = stream(spark, tmp_path, "k", [(1, at(-30), [0.0, 0.0, 0.0, 0.9, 0.1]), (2, at(90), [1.0, 0.0, 0.0, 0.0, 0.0])], "event_id long, replied_at timestamp, probabilities array<double>")
    assert [(r.event_id, r.verdict_match) for r in run(live.with_canary(e, c), "canary").collect()] == [(1, True)]


def test_streamed_rates(spark, tmp_path):
    rows = [("a", at(0), "/x", 200), ("a", at(1), "/y", 404), ("a", at(30), "/x", 200), ("a", at(90), "/x", 200), ("b", at(2), "/x", 404)]
    s = stream(spark, tmp_path, "l", rows, "client_ip string, ts timestamp, path string, status_code int")
    got = {(r.client_ip, r.ts): (r.req_count, r.error_rate_4xx, r.endpoint_diversity) for r in run(live.client_rates(s), "rates").collect()}
    assert got == {("a", at(0)): (0, 0.0, 0), ("a", at(1)): (1, 0.0, 1), ("a", at(30)): (2, 0.5, 2), ("a", at(90)): (1, 0.0, 1), ("b", at(2)): (0, 0.0, 0)}


def test_streamed_late_patches(spark, tmp_path):
    e = stream(spark, tmp_path, "ev", [(1, at(0), "pass", 0.0), (2, at(0), "block", 0.0), (3, at(0), "pass", 0.0), (4, at(0), "timeout", 0.0), (9, at(100), "pass", 0.0)], "event_id long, ts timestamp, verdict string, if_score double")
    r = stream(spark, tmp_path, "rp", [(1, at(0.02), 0.001), (2, at(0.02), 0.001), (3, at(0.2), 0.001), (4, at(0.02), 0.001), (8, at(100), 0.1)], "event_id long, replied_at timestamp, late double")
    got = {x.event_id: (x.verdict, x.if_score, x.is_anomaly, x.patched) for x in run(live.late_patches(e, r), "late").collect()}
    assert got[1] == ("pass_anomaly", 0.001, True, True) and got[2] == ("block", 0.001, True, True)
    assert all(not got[k][3] for k in (3, 4) if k in got)


def test_streamed_ingest_and_bounded_run(spark, tmp_path):
    s = stream(spark, tmp_path, "t", [('{"vector": [1, 2], "predicted_class": "xss", "confidence": 0.5, "timestamp": 3, "source_id": "h"}',), ("no json",)], "value string")
    q = live.ingest(s, 2).writeStream.format("memory").queryName("ingested").trigger(availableNow=True).start()
    assert live.run_for(q, 60)
    assert sorted((r.error is None, r.confidence) for r in spark.table("ingested").collect()) == [(False, None), (True, 0.5)]


def test_distinct_in_windows():
    values = np.array(list("abacbbad"), object)
    low, high = np.array([0, 0, 1, 2, 5]), np.array([0, 3, 4, 6, 8])
    assert live.distinct_in(values, low, high).tolist() == [len(set(values[a:b])) for a, b in zip(low, high, strict=True)]


def test_registry_and_reports(spark, tmp_path):
    r = sinks.Registry(spark, str(tmp_path / "registry"))
    assert r.list().count() == 0
    r.add("a", "https://one")
    r.add("b", "https://two")
    r.remove("a")
    assert [x.url for x in r.list().collect()] == ["https://two"] and r.get("a").count() == 0
    with pytest.raises(ValueError):
        r.add("c", "http://plain")
    d = spark.createDataFrame([(1, "x")], "n int, t string")
    for kind in ("json", "csv"):
        sinks.write_report(d, str(tmp_path / kind), kind)
    assert spark.read.json(str(tmp_path / "json")).first().t == "x"


def test_notifications_reach_all_pages_of_addresses(spark, tmp_path):
    out = tmp_path / "all"
    out.mkdir()
    rows = spark.createDataFrame([(1, "block")], "event_id long, verdict string")
    registry = spark.createDataFrame([(f"u{i}", "active") for i in range(23)], "url string, status string")
    sinks.notify(rows, registry, lambda url, value: (out / url).write_text(value), page=5)
    assert len(list(out.iterdir())) == 23


def test_notifications_survive_failures(spark, tmp_path):
    out = tmp_path / "sent"
    out.mkdir()

    def send(url, value):
        if "bad" in url:
            raise OSError
        (out / f"{url}-{json.loads(value)['event_id']}").write_text(value)

    rows = spark.createDataFrame([(1, "block"), (2, "pass"), (3, "pass_anomaly")], "event_id long, verdict string")
    registry = spark.createDataFrame([("bad", "active"), ("u", "active"), ("gone", "removed")], "url string, status string")
    sinks.notify(rows, registry, send)
    assert sorted(p.name for p in out.iterdir()) == ["u-1", "u-3"]
    with pytest.raises(ValueError):
        sinks.csv_to_parquet(spark, str(tmp_path / "none"), str(tmp_path / "q"), "x int") if (tmp_path / "none").exists() else (_ for _ in ()).throw(ValueError())


# First replies, telemetry logs


def micro_batches(spark, tmp_path, name, batches, schema):
    """A stream that reads one file a micro-batch, in the order of the batches."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        part = next((tmp_path / f"{name}-{i}").glob("part-*.parquet"))
        (tmp_path / name).mkdir(exist_ok=True)
        target = tmp_path / name / f"{i:03}.parquet"
        target.write_bytes(part.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


EVENT, REPLY = "event_id long, ts timestamp, verdict string, if_score double", "event_id long, replied_at timestamp, late double"
EVENTS = [
    [(1, at(0), "pass", 0.5), (2, at(0), "pass", 0.5), (3, at(0), "timeout", 0.0)],
    # the first event is read again, two of one id at once, and one without an id
    [(1, at(0), "pass", 0.5), (4, at(0.01), "block", 0.5), (4, at(0.01), "block", 0.5), (None, at(0), "pass", 0.0)],
    [(5, at(0.02), "pass", 0.5), (6, at(0.02), "pass", 0.5)], [(90, at(100), "pass", 0.0)], [(1, at(0), "pass", 0.5)], [(91, at(300), "pass", 0.0)],
]
REPLIES = [
    # two replies of 1, the later one read first; one before its event is read; one that comes too late; one too early
    [(1, at(0.04), 0.9), (4, at(0.03), 0.001), (2, at(0.2), 0.001), (5, at(0.01), 0.001)],
    [(1, at(0.02), 0.001), (1, at(0.02), 0.001), (3, at(0.01), 0.001), (6, at(0.03), None)], [(6, at(0.04), 0.8), (None, at(0), 0.1)], [(90, at(100.01), 0.7)], [(1, at(0.03), 0.6)], [(8, at(300), 0.1)],
]
EXPECTED = {1: ("pass_anomaly", 0.001, True, True), 2: ("pass", 0.5, False, False), 3: ("timeout", 0.0, False, False), 4: ("block", 0.001, True, True), 5: ("pass", 0.5, False, False), 6: ("pass", 0.8, False, True), 90: ("pass", 0.7, False, True)}


def test_two_replies_give_one_event(spark, tmp_path):
    e, r = micro_batches(spark, tmp_path, "e", EVENTS, EVENT), micro_batches(spark, tmp_path, "r", REPLIES, REPLY)
    rows = run(live.late_patches(e, r), "first_replies").collect()
    got = {x.event_id: (x.verdict, x.if_score, x.is_anomaly, x.patched) for x in rows}
    assert len(rows) == len(got) and got == EXPECTED


def test_two_replies_of_a_batch_frame(spark):
    flat = lambda batches, schema: spark.createDataFrame([x for b in batches for x in b], schema).repartition(3)
    rows = live.late_patches(flat(EVENTS, EVENT), flat(REPLIES, REPLY)).collect()
    got = {x.event_id: (x.verdict, x.if_score, x.is_anomaly, x.patched) for x in rows}
    assert len(rows) == len(got) and {k: v for k, v in got.items() if k != 91} == EXPECTED
    asked = spark.createDataFrame([(1, at(0)), (1, at(0)), (2, at(0))], "id long, ts timestamp")
    told = spark.createDataFrame([(1, at(0.03), [0.1]), (1, at(0.01), [0.2])], "id long, replied_at timestamp, probabilities array<double>")
    assert sorted((r.id, r.probabilities) for r in live.with_replies(asked, told).collect()) == [(1, [0.2]), (2, None)]
    events = spark.createDataFrame([(1, at(0), "block", 0.9)], "event_id long, ts timestamp, verdict string, confidence double")
    canary = spark.createDataFrame([(1, at(5), [0.0, 0.0, 0.0, 0.9, 0.1]), (1, at(9), [1.0, 0.0, 0.0, 0.0, 0.0])], "event_id long, replied_at timestamp, probabilities array<double>")
    assert [r.verdict_match for r in live.with_canary(events, canary).collect()] == [True]


def test_first_replies_survive_restarts(spark, tmp_path):
    path, checkpoint = str(tmp_path / "merged"), str(tmp_path / "c")
    for stop in (1, 3, 6):
        e, r = micro_batches(spark, tmp_path / "x", "e", EVENTS[:stop], EVENT), micro_batches(spark, tmp_path / "x", "r", REPLIES[:stop], REPLY)
        query = telemetry.merge_events(live.late_patches(e, r), path, checkpoint).start()
        live.drain(query)
        for old in (tmp_path / "x").glob("[er]-*"):
            old.rename(tmp_path / f"{old.name}-{stop}")
    rows = spark.read.parquet(path).collect()
    assert sorted(x.event_id for x in rows) == sorted(EXPECTED)
    assert {x.event_id: (x.verdict, x.if_score, x.is_anomaly, x.patched) for x in rows} == EXPECTED


def test_a_batch_written_again_takes_its_own_place(spark, tmp_path):
    for _ in range(2):
        telemetry.write_batch(spark.range(3), 7, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def line(i, **changes):
    return json.dumps({"vector": [float(i), 2.0], "predicted_class": "xss", "confidence": 0.5, "timestamp": 3 + i, "source_id": "h"} | changes) + "\n"


def test_telemetry_logs_are_read_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    accepted, rejected, checkpoint = (str(tmp_path / n) for n in ("ok", "bad", "check"))

    def go():
        # small parts and batches: lines lie across both
        stream = telemetry.telemetry_stream(spark, str(logs), 2, part=150, batch=1000)
        live.drain(telemetry.store_telemetry(stream, accepted, rejected, checkpoint).start())

    with (logs / "a.jsonl").open("a") as f:
        f.writelines(line(i) for i in range(40))
        f.write("no json\n" + line(1000, source_id="") + line(40)[:20])  # the last line is not ended
    (logs / "b.jsonl").write_text("".join(line(i) for i in range(100, 110)))
    go()
    first = spark.read.parquet(accepted).collect()
    assert sorted(r.timestamp - 3 for r in first) == [*range(40), *range(100, 110)]
    assert spark.read.parquet(rejected).count() == 2
    # the line ends, files grow, a new one comes, and the query starts again
    with (logs / "a.jsonl").open("a") as f:
        f.write(line(40)[20:] + "".join(line(i) for i in range(41, 60)))
    (logs / "c.jsonl").write_text(line(200, note="x" * 3000))
    go()
    go()
    rows = spark.read.parquet(accepted).collect()
    assert sorted(r.timestamp - 3 for r in rows) == [*range(60), *range(100, 110), 200]
    assert len({(r.file, r.at) for r in rows}) == len(rows)
    bad = spark.read.parquet(rejected).collect()
    assert sorted(r.error.split()[0] for r in bad) == ["source_id", "vector"] and "no json" in {r.value for r in bad}
    assert sum(r.n for r in telemetry.rejected_counts(spark.read.parquet(rejected)).collect()) == 2
