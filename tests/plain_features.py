"""All 76 request features in plain Python, as an oracle for the column expressions."""

from __future__ import annotations

import math
import re
from collections import Counter
from urllib.parse import unquote, unquote_to_bytes

import regex

from weir.functions import patterns as P
from weir.functions.features import NAMES

_JSON_QUOTE = r'"(?=\s*[:,}\]])|(?<=[:,{\[]\s*)"'


def wide(pattern: str) -> str:
    """The pattern with white space as browsers know it; other classes are ASCII."""
    spaces = re.escape(P.SPACES)
    return re.sub(r"\\s", lambda m: f"[{spaces}]", pattern)


def count(text: str, pattern: str) -> int:
    return sum(1 for _ in regex.finditer(wide(pattern), text, regex.ASCII | regex.VERSION0))


def test(text: str, pattern: str) -> int:
    return int(regex.search(wide(pattern), text, regex.ASCII | regex.VERSION0) is not None)


test.__test__ = False


def decode(s: str) -> str:
    if re.search("%(?![0-9a-fA-F]{2})", s):
        return s
    try:
        return unquote_to_bytes(s).decode()
    except UnicodeDecodeError:
        return s


def entities(s: str) -> str:
    for name, c in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'")):
        s = re.sub(name, c, s, flags=re.I)
    s = re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1]) % 65536), s)
    return re.sub(r"&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16) % 65536), s, flags=re.I)


def normalise(s: str) -> str:
    for _ in range(5):
        new = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), entities(decode(s)))
        if new == s:
            break
        s = new
    return s


def signal(s: str) -> int:
    if len(s) < 2:
        return 0
    d = normalise(s)
    xss = count(d, P.XSS_MARKER) + 2 * test(d, P.SCRIPT_TAG) + count(d, P.JS_EVENT_HANDLER) + test(d, P.ALERT_FUNCTION)
    plain = sum(count(s, p) for p in (P.SQL_KEYWORDS, P.SQLI_OPERATOR, P.SHELL_COMMAND, P.COMMAND_SEPARATOR, P.SUBSHELL, P.DOTDOT_ENCODED))
    return xss + plain + 2 * (test(s, P.UNION) + count(s, P.TRAVERSAL_SEQUENCE) + test(s, P.SENSITIVE_FILE))


def best_field(body: str) -> str:
    lenient = lambda x: unquote(x.replace("+", " "))
    if "=" not in body:
        return body
    fields: dict = {}
    for piece in (body[1:] if body.startswith("?") else body).split("&"):
        if piece:
            k, _, v = piece.partition("=")
            fields[lenient(k)] = lenient(v)
    if len(fields) < 2:
        return body
    best = max((signal(v) for v in fields.values() if len(v) >= 2), default=0)
    return next(v for v in fields.values() if len(v) >= 2 and signal(v) == best) if best > 0 else body


def payload(path: str, query: str, body: str) -> str:
    offered = [x for x, ok in ((best_field(body), bool(best_field(body))), (query, bool(query)), (path, len(path) > 1)) if ok]
    if not offered:
        return path
    if len(offered) == 1:
        return offered[0]
    score = lambda x: max(signal(x), signal(decode(x))) if decode(x) != x else signal(x)
    return max(offered, key=score)  # the first of equals


def entropy(s: str) -> float:
    b = s.encode()
    return sum(-(n / len(b)) * math.log2(n / len(b) + 1e-12) for n in Counter(b).values())


def tokens(s: str) -> int:
    return count(s, rf"[^{re.escape(P.SPACES)}]+")


def features(method="", path="", query="", body="", user_agent="", content_type="", extra_headers=None, status_code=0) -> dict[str, float]:
    pay = payload(path, query, body)
    dec = normalise(pay)
    tra = re.sub("^/", "", pay) if pay == path and not body and not query else pay
    uri = f"{path}?{query}" if query else path
    before = re.sub(r"\?[^\n\r\u2028\u2029]*\Z", "", uri)
    long, headers = max(len(pay), 1), extra_headers or {}
    c, t = (lambda p: count(pay, p)), test
    quotes = c("['\"]")
    shell = len({m.group().lower() for m in regex.finditer(wide(P.SHELL_COMMAND), pay, regex.ASCII)})
    values = [
        len(pay), entropy(pay), len(uri), len(before), len(query), len(body), entropy(body), before.count("/"), query.count("&") + bool(query), int("#" in uri),
        c(P.SPECIAL_CHAR) / long, c("[0-9]") / long, c("[A-Z]") / long, sum(x in P.SPACES for x in pay), c(r"[\n\r]") + c(P.NEWLINE_ENCODED), pay.count("\x00") + c(P.NULL_BYTE_ENCODED), sum(ord(x) > 127 for x in pay) / long, tokens(pay),
        c(P.URL_ENCODED) / long, c(P.URL_ENCODED), c(P.DOUBLE_ENCODED), c(P.HEX_ESCAPE), c(P.UNICODE_ESCAPE), c(P.HTML_ENTITY), c(P.BASE64_LIKE),
        c(P.SQL_KEYWORDS), c(P.SQL_KEYWORDS) / max(tokens(pay), 1), c(P.SQLI_COMMENT), c(P.SQLI_OPERATOR), max(0, c(P.SQLI_OPERATOR) - c(P.FORM_FIELD)), quotes, max(0, quotes - c(_JSON_QUOTE)), pay.count(";"), c("[()]"), t(pay, P.UNION), t(pay, P.SELECT),
        count(dec, P.XSS_MARKER), count(dec, P.XSS_MARKER) / max(len(dec), 1) * 100, count(dec, P.HTML_TAG), t(dec, P.SCRIPT_TAG), count(dec, P.JS_EVENT_HANDLER), count(dec, P.JAVASCRIPT_URL), c(P.HTML_ENTITY) / long * 100, t(dec, P.ALERT_FUNCTION), t(dec, P.INLINE_STYLE),
        count(tra, P.TRAVERSAL_SEQUENCE), count(tra, P.PATH_SEPARATOR), t(tra, P.ABSOLUTE_PATH), t(tra, P.SENSITIVE_FILE), count(tra, P.SENSITIVE_EXTENSION), count(tra, P.SUSPICIOUS_EXTENSION), count(tra, P.DOTDOT_ENCODED),
        pay.count("|"), pay.count("`"), c(P.SHELL_COMMAND), c(P.COMMAND_SEPARATOR), c(P.REDIRECT_OPERATOR), pay.count("$"), c(P.SUBSHELL), t(pay, P.OS_PATH), shell, shell / (c(P.TRAVERSAL_SEQUENCE) + c(P.PATH_SEPARATOR) + 1),
        method.upper() == "GET", method.upper() == "POST", bool(user_agent), len(user_agent), t(user_agent, P.SCANNER_AGENT), t(content_type, P.FORM_TYPE), len(headers.get("authorization", "")), sum(k.lower() not in P.STANDARD_HEADERS for k in headers), status_code,
        0, 0, 0, 0, 0,
    ]
    return dict(zip(NAMES, map(float, values), strict=True))
