"""DuckDB SQL of the 76 request features, for texts in which nothing is percent, entity or escape encoded.

Decoding has queries of its own (`decoded_texts`), whose texts come back as they were.
"""

from __future__ import annotations

from weir.functions import patterns as P
from weir.functions.features import NAMES
from weir.plans import views as V


def _pattern(pattern: str) -> str:
    return "'" + pattern.replace(r"\s", f"[{P.SPACE_CLASS}]").replace("'", "''") + "'"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_pattern(pattern)}))"


def _has(text: str, pattern: str) -> str:
    return f"CAST(regexp_matches({text}, {_pattern(pattern)}) AS INTEGER)"


def _operators(text: str) -> str:
    return _n(text, r"<>=?|!=|>=|<=|=+")


def _comments(text: str) -> str:
    return f"({_n(text, r'--|/\*|\*/')} + {_n(text, '#')} - {_n(text, '#[0-9]')})"


def _json_quotes(text: str) -> str:
    """Of the pieces between quotes, how many edges have a mark after the quote or before it."""
    after, before = f"regexp_matches(q[i + 1], {_pattern(r'^\s*[:,}\]]')})", f"regexp_matches(q[i], {_pattern(r'[:,{\[]\s*$')})"
    q = f"string_split({text}, '\"')"
    body = f"({after} OR {before})".replace("q[", f"{q}[")
    return f"len(list_filter(range(1, len({q})), lambda i: {body}))"


def _entropy(text: str) -> str:
    """Of the shares of bytes; empty text has none."""
    counts = f"map_values(list_histogram(regexp_extract_all(hex(encode({text})), '..')))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE round(list_sum(list_transform({counts}, lambda k: -(k / strlen({text})) * log2(k / strlen({text}) + 1e-12))), 8) END"


def _signal(t: str) -> str:
    once = [_n(t, p) for p in (P.XSS_MARKER, P.JS_EVENT_HANDLER, P.SQL_KEYWORDS, P.SHELL_COMMAND, P.COMMAND_SEPARATOR, P.SUBSHELL, P.DOTDOT_ENCODED)]
    twice = [_has(t, P.SCRIPT_TAG), _has(t, P.UNION), _n(t, P.TRAVERSAL_SEQUENCE), _has(t, P.SENSITIVE_FILE)]
    return f"CASE WHEN length({t}) < 2 THEN 0 ELSE {_operators(t)} + {_has(t, P.ALERT_FUNCTION)} + {' + '.join(once)} + 2 * ({' + '.join(twice)}) END"


def _features() -> dict[str, str]:
    t, long = "t", "greatest(length(t), 1)"
    n = lambda p: _n(t, p)
    shell = f"len(list_distinct(list_transform(regexp_extract_all(t, {_pattern(P.SHELL_COMMAND)}), lambda x: lower(x))))"
    words = n(f"[^{P.SPACE_CLASS}]+")
    counts = {
        "whitespace_count": r"\s", "encoded_char_freq": P.URL_ENCODED, "double_encoded_count": P.DOUBLE_ENCODED, "hex_escape_count": P.HEX_ESCAPE, "unicode_escape_count": P.UNICODE_ESCAPE,
        "html_entity_count": P.HTML_ENTITY, "base64_like_count": P.BASE64_LIKE, "sqli_keyword_count": P.SQL_KEYWORDS, "quote_count": "['\"]", "semicolon_count": ";", "parenthesis_count": "[()]",
        "xss_marker_count": P.XSS_MARKER, "html_tag_count": P.HTML_TAG, "js_event_handler_count": P.JS_EVENT_HANDLER, "javascript_url_count": P.JAVASCRIPT_URL,
        "pipe_count": r"\|", "backtick_count": "`", "shell_command_count": P.SHELL_COMMAND, "command_separator_count": P.COMMAND_SEPARATOR, "redirect_operator_count": P.REDIRECT_OPERATOR, "dollar_sign_count": r"\$", "subshell_count": P.SUBSHELL,
    }
    paths = {"traversal_sequence_count": P.TRAVERSAL_SEQUENCE, "path_separator_count": P.PATH_SEPARATOR, "sensitive_extension_count": P.SENSITIVE_EXTENSION, "file_extension_suspicious": P.SUSPICIOUS_EXTENSION, "dotdot_encoded_count": P.DOTDOT_ENCODED}
    present = {"union_present": P.UNION, "select_present": P.SELECT, "script_tag_present": P.SCRIPT_TAG, "alert_function_present": P.ALERT_FUNCTION, "inline_style_present": P.INLINE_STYLE, "os_path_indicator": P.OS_PATH}
    shares = {"special_char_ratio": P.SPECIAL_CHAR, "numeric_char_ratio": P.NUMERIC_CHAR, "uppercase_ratio": P.UPPERCASE_CHAR, "extended_ascii_ratio": r"[^\x00-\x7F]", "url_encoded_ratio": P.URL_ENCODED}
    return (
        {k: n(p) for k, p in counts.items()} | {k: _n("tr", p) for k, p in paths.items()} | {k: _has(t, p) for k, p in present.items()} | {k: f"{n(p)} / {long}" for k, p in shares.items()}
        | {"absolute_path_indicator": _has("tr", P.ABSOLUTE_PATH), "sensitive_file_target": _has("tr", P.SENSITIVE_FILE)}
        | {
            "payload_length": "length(t)", "payload_entropy": _entropy("t"), "uri_length": "length(uri)", "path_length": "length(before)", "query_string_length": "length(query)", "body_length": "length(body)", "body_entropy": _entropy("body"),
            "path_depth": _n("before", "/"), "query_param_count": f"{_n('query', '&')} + CAST(query <> '' AS INTEGER)", "fragment_present": "contains(uri, '#')",
            "newline_char_count": f"{n(P.NEWLINE)} + {n(P.NEWLINE_ENCODED)}", "null_byte_count": f"{n(P.NULL_BYTE)} + {n(P.NULL_BYTE_ENCODED)}", "payload_token_count": words,
            "sqli_keyword_density": f"{n(P.SQL_KEYWORDS)} / greatest({words}, 1)", "sqli_comment_count": _comments(t), "sqli_operator_count": _operators(t), "non_form_operator_count": f"greatest(0, {_operators(t)} - {n(P.FORM_FIELD)})",
            "non_json_quote_count": f"greatest(0, {n(chr(91) + chr(39) + chr(34) + chr(93))} - {_json_quotes(t)})", "xss_marker_density": f"{n(P.XSS_MARKER)} / {long} * 100", "html_entity_density": f"{n(P.HTML_ENTITY)} / {long} * 100",
            "distinct_shell_command_count": shell, "shell_to_path_ratio": f"{shell} / ({n(P.TRAVERSAL_SEQUENCE)} + {n(P.PATH_SEPARATOR)} + 1)",
            "method_is_get": "upper(method) = 'GET'", "method_is_post": "upper(method) = 'POST'", "ua_present": "agent <> ''", "ua_length": "length(agent)", "ua_suspicious": _has("agent", P.SCANNER_AGENT),
            "content_type_encoded": _has("content_type", P.FORM_TYPE), "authorization_length": "length('Bearer abc')", "unusual_headers_count": "1", "status_code": "status_code",
        }
        | {k: "0" for k in ("req_count_1s", "req_count_5s", "req_count_60s", "error_rate_4xx_60s", "endpoint_diversity_60s")}
    )


def payload_ctes(requests: str = V.REQUESTS) -> str:
    """WITH clause up to `chosen`: the payload t of each request, by the rules of `features.with_payload`."""
    return f"""WITH {requests},
r AS (SELECT doc_id, label, method, path, query, coalesce(body, '') AS body, coalesce(user_agent, '') AS agent, content_type, status_code, path || '?' || query AS uri FROM requests),
fields AS (SELECT doc_id, list_filter(string_split(regexp_replace(body, '^\\?', ''), '&'), lambda x: x <> '') AS l FROM r WHERE contains(body, '=')),
one AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM fields),
pair AS (SELECT doc_id, i, replace(split_part(x, '=', 1), '+', ' ') AS k, CASE WHEN contains(x, '=') THEN replace(substr(x, instr(x, '=') + 1), '+', ' ') ELSE '' END AS v FROM one),
last_of AS (SELECT doc_id, k, min(i) AS i, arg_max(v, i) AS v FROM pair GROUP BY doc_id, k),
form AS (SELECT doc_id, i, v FROM last_of QUALIFY count(*) OVER (PARTITION BY doc_id) > 1),
texts AS (SELECT doc_id, 0 AS place, 0 AS i, body AS t FROM r UNION ALL SELECT doc_id, 1, 0, query FROM r UNION ALL SELECT doc_id, 2, 0, path FROM r UNION ALL SELECT doc_id, 3, i, v FROM form),
scored AS (SELECT *, {_signal("t")} AS s FROM texts),
best AS (SELECT doc_id, first(t ORDER BY s DESC, i) AS t, max(s) AS s FROM scored WHERE place = 3 GROUP BY doc_id HAVING max(s) > 0),
offered AS (SELECT x.doc_id, x.place, CASE WHEN x.place = 0 THEN coalesce(b.t, x.t) ELSE x.t END AS t, CASE WHEN x.place = 0 THEN coalesce(b.s, x.s) ELSE x.s END AS s FROM scored x LEFT JOIN best b USING (doc_id) WHERE x.place < 3),
chosen AS (SELECT doc_id, coalesce(first(t ORDER BY s DESC, place) FILTER (length(t) > CASE WHEN place = 2 THEN 1 ELSE 0 END), first(t ORDER BY place DESC)) AS t FROM offered GROUP BY doc_id)"""


def request_features_sql() -> str:
    found = _features()
    columns = ", ".join(f"CAST({found[n]} AS DOUBLE) AS {n}" for n in NAMES)
    return f"""{payload_ctes()},
d AS (SELECT r.*, t, CASE WHEN t = path AND body = '' AND query = '' THEN regexp_replace(t, '^/', '') ELSE t END AS tr, regexp_replace(uri, '\\?[^\\n\\r\\x{{2028}}\\x{{2029}}]*\\z', '') AS before FROM r JOIN chosen USING (doc_id))
SELECT doc_id, label, {columns} FROM d"""
