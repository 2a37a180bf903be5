"""Marks of attacks in batches of texts: the choice of a request's payload and the counts on it.

A UDF over Arrow batches. Patterns run in Arrow's kernels, which take time linear in the
text whatever it holds; classes of characters and entropies come from one table of byte
counts a batch. Nothing here runs a row at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weir.functions import patterns as P

#: A mark put in place of a match; texts have it replaced beforehand, by another character that no pattern names.
MARK, NO_MARK = "\x01", "\x02"
#: Bytes that are counted at once.
BLOCK = 1 << 23
#: Patterns that look around a match, as others with the same matches, or with as many.
COMMENT_HASH, COMMENT_NUMBER, COMMENT_PAIR = "#", "#[0-9]", r"(--|/\*|\*/)"
OPERATOR = r"(<>=?|!=|>=|<=|=+)"
FOLLOWED_QUOTE, PRECEDED_QUOTE = r'"(\s*[:,}\]])', r'[:,{\[]\s*"'
WIDE_SPACES = "".join(c for c in P.SPACES if ord(c) > 127)


def linear(pattern: str) -> str:
    """The pattern with the white space of browsers."""
    return pattern.replace(r"\s", f"[{P.SPACE_CLASS}]")


def whole(texts: pa.Array) -> pa.Array:
    """Texts with null as empty."""
    return pc.fill_null(texts.cast(pa.large_string()), "")


def clean(texts: pa.Array) -> pa.Array:
    """Whole texts without the mark, and without the two letters that fold to ASCII ones."""
    texts = whole(texts)
    for old, new in ((MARK, NO_MARK), ("ſ", "\xe9"), ("K", "\xe9")):
        if pc.any(pc.match_substring(texts, old)).as_py():
            texts = pc.replace_substring(texts, old, new)
    return texts


def numbers(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def count(texts: pa.Array, pattern: str) -> np.ndarray:
    """Matches in each text. Patterns that begin with a look at what is before them see the whole text, so these are marked first."""
    if pattern.removeprefix("(?i)").startswith((r"\b", "^", "(^")):
        return numbers(pc.count_substring(pc.replace_substring_regex(texts, linear(pattern), MARK), MARK))
    return numbers(pc.count_substring_regex(texts, linear(pattern)))


def test(texts: pa.Array, pattern: str) -> np.ndarray:
    return numbers(pc.match_substring_regex(texts, linear(pattern)))


test.__test__ = False


def byte_counts(texts: pa.Array) -> np.ndarray:
    """A row of 256 counts for each text."""
    lengths = numbers(pc.binary_length(texts))
    out = np.zeros((len(texts), 256), np.int64)
    if not lengths.sum():
        return out
    data = np.frombuffer(pa.concat_arrays([texts]).buffers()[2], np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")) - 1)
        last = min(last, len(texts), first + 4096)
        key = np.repeat(np.arange(last - first) * 256, lengths[first:last]) + data[ends[first] : ends[last]]
        out[first:last] = np.bincount(key, minlength=256 * (last - first)).reshape(-1, 256)
        first = last
    return out


def entropy(counts: np.ndarray) -> np.ndarray:
    """Shannon entropy of the bytes, -sum p log2(p + 1e-12); 0 for empty text."""
    at = np.flatnonzero(counts)
    row, n = at // 256, counts.ravel()[at]
    p = n / np.maximum(counts.sum(1), 1)[row]
    return np.bincount(row, -(p * np.log2(p + 1e-12)), len(counts))


def operators(texts: pa.Array) -> np.ndarray:
    return count(texts, OPERATOR)


def comments(texts: pa.Array) -> np.ndarray:
    return count(texts, COMMENT_PAIR) + count(texts, COMMENT_HASH) - count(texts, COMMENT_NUMBER)


def json_quotes(texts: pa.Array) -> np.ndarray:
    """Quotes that a mark of JSON follows, and of the others those that one precedes."""
    followed = count(texts, FOLLOWED_QUOTE)
    rest = pc.replace_substring_regex(texts, linear(FOLLOWED_QUOTE), MARK + r"\1")
    return followed + count(rest, PRECEDED_QUOTE)


def distinct_matches(texts: pa.Array, pattern: str, found: np.ndarray) -> np.ndarray:
    """The number of different matches, whatever their case; `found` is the number of all."""
    out = np.minimum(found, 1)
    rows = np.flatnonzero(found > 1)
    if len(rows):
        pieces = pc.split_pattern(pc.replace_substring_regex(texts.take(pa.array(rows)), linear(pattern), MARK + r"\0" + MARK), MARK)
        sizes = numbers(pc.list_value_length(pieces))
        row = np.repeat(rows, sizes)
        # pieces of a text alternate: between matches, a match
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = pc.utf8_lower(pieces.flatten().filter(pa.array(at % 2 == 1))).dictionary_encode()
        pairs = np.unique(row[at % 2 == 1] * len(words.dictionary) + words.indices.to_numpy())
        out[rows] = np.bincount(pairs // len(words.dictionary), minlength=len(texts))[rows]
    return out


def attack_signal(raw: pa.Array, decoded: pa.Array) -> np.ndarray:
    """The weighted sum of attack markers by which payloads are compared; 0 below two characters."""
    score = count(decoded, P.XSS_MARKER) + 2 * test(decoded, P.SCRIPT_TAG) + count(decoded, P.JS_EVENT_HANDLER) + test(decoded, P.ALERT_FUNCTION) + operators(raw)
    for p in (P.SQL_KEYWORDS, P.SHELL_COMMAND, P.COMMAND_SEPARATOR, P.SUBSHELL, P.DOTDOT_ENCODED):
        score += count(raw, p)
    score += 2 * (test(raw, P.UNION) + count(raw, P.TRAVERSAL_SEQUENCE) + test(raw, P.SENSITIVE_FILE))
    return np.where(numbers(pc.utf8_length(raw)) < 2, 0, score)


def choose(sizes: np.ndarray, text: pa.Array, once: pa.Array, full: pa.Array, once_full: pa.Array) -> np.ndarray:
    """The place, in all texts end to end, of each request's payload.

    A request has `sizes` texts: the body, the query, the path and the values of the body's
    form. `once` has them percent-decoded and `full` fully decoded, null where that changes
    nothing; `once_full` has the former fully decoded. The form value of the highest positive
    score, the first of equals, stands for the body; of body, query and path (longer than one
    character) the one that scores highest, decoded or not, is taken, the first of equals.
    """
    texts = clean(text)
    plain = attack_signal(texts, clean(pc.coalesce(full, text)))
    starts, n = np.cumsum(sizes) - sizes, len(sizes)
    score = plain.copy()
    twice = np.flatnonzero(numbers(pc.is_valid(once)))
    if len(twice):
        at = pa.array(twice)
        score[twice] = np.maximum(plain[twice], attack_signal(clean(once.take(at)), clean(once_full.take(at))))
    row = np.repeat(np.arange(n), sizes)
    values = np.flatnonzero((np.arange(len(row)) - starts[row] >= 3) & (plain > 0))
    place = starts[:, None] + np.arange(3)
    best = values[np.lexsort((values, -plain[values], row[values]))]
    at, first = np.unique(row[best], return_index=True)
    place[at, 0] = best[first]
    length = numbers(pc.utf8_length(texts))
    found = np.where(length[place] > np.array([0, 0, 1]), score[place], -1)
    # where nothing is offered the path is taken
    pick = np.where(found.max(1) < 0, 2, found.argmax(1)) if n else np.zeros(0, np.int64)
    return place[np.arange(n), pick]


def marks(payload: pa.Array, decoded: pa.Array, traversal: pa.Array, body: pa.Array, agent: pa.Array, kind: pa.Array) -> dict[str, np.ndarray]:
    """The features that need a search of texts, by their names."""
    h = byte_counts(whole(payload))
    pay, decoded, traversal, agent, kind = (clean(x) for x in (payload, decoded, traversal, agent, kind))
    of = lambda characters: h[:, [ord(c) for c in characters if ord(c) < 128]].sum(1)
    c = lambda p: count(pay, p)
    length = numbers(pc.utf8_length(pay))
    long, dec_long = np.maximum(length, 1), np.maximum(numbers(pc.utf8_length(decoded)), 1)
    spaces = of(P.SPACES) + c(f"[{WIDE_SPACES}]")
    words, keywords, quotes, entities, shell, equals, escapes = c(f"[^{P.SPACE_CLASS}]+"), c(P.SQL_KEYWORDS), of("'\""), c(P.HTML_ENTITY), c(P.SHELL_COMMAND), operators(pay), c(P.URL_ENCODED)
    xss, kinds = count(decoded, P.XSS_MARKER), distinct_matches(pay, P.SHELL_COMMAND, shell)
    return {
        "payload_length": length, "payload_entropy": entropy(h), "body_entropy": entropy(byte_counts(whole(body))),
        "special_char_ratio": of(P.CHARACTERS[P.SPECIAL_CHAR]) / long, "numeric_char_ratio": of("0123456789") / long, "uppercase_ratio": h[:, 65:91].sum(1) / long, "whitespace_count": spaces,
        "newline_char_count": of("\n\r") + c(P.NEWLINE_ENCODED), "null_byte_count": of("\x00") + c(P.NULL_BYTE_ENCODED), "extended_ascii_ratio": h[:, 192:].sum(1) / long, "payload_token_count": words,
        "url_encoded_ratio": escapes / long, "encoded_char_freq": escapes, "double_encoded_count": c(P.DOUBLE_ENCODED), "hex_escape_count": c(P.HEX_ESCAPE), "unicode_escape_count": c(P.UNICODE_ESCAPE),
        "html_entity_count": entities, "base64_like_count": c(P.BASE64_LIKE),
        "sqli_keyword_count": keywords, "sqli_keyword_density": keywords / np.maximum(words, 1), "sqli_comment_count": comments(pay), "sqli_operator_count": equals,
        "non_form_operator_count": np.maximum(0, equals - c(P.FORM_FIELD)), "quote_count": quotes, "non_json_quote_count": np.maximum(0, quotes - json_quotes(pay)), "semicolon_count": of(";"), "parenthesis_count": of("()"),
        "union_present": test(pay, P.UNION), "select_present": test(pay, P.SELECT),
        "xss_marker_count": xss, "xss_marker_density": xss / dec_long * 100, "html_tag_count": count(decoded, P.HTML_TAG), "script_tag_present": test(decoded, P.SCRIPT_TAG),
        "js_event_handler_count": count(decoded, P.JS_EVENT_HANDLER), "javascript_url_count": count(decoded, P.JAVASCRIPT_URL), "html_entity_density": entities / long * 100,
        "alert_function_present": test(decoded, P.ALERT_FUNCTION), "inline_style_present": test(decoded, P.INLINE_STYLE),
        "traversal_sequence_count": count(traversal, P.TRAVERSAL_SEQUENCE), "path_separator_count": count(traversal, P.PATH_SEPARATOR), "absolute_path_indicator": test(traversal, P.ABSOLUTE_PATH),
        "sensitive_file_target": test(traversal, P.SENSITIVE_FILE), "sensitive_extension_count": count(traversal, P.SENSITIVE_EXTENSION), "file_extension_suspicious": count(traversal, P.SUSPICIOUS_EXTENSION), "dotdot_encoded_count": count(traversal, P.DOTDOT_ENCODED),
        "pipe_count": of("|"), "backtick_count": of("`"), "shell_command_count": shell, "command_separator_count": c(P.COMMAND_SEPARATOR), "redirect_operator_count": c(P.REDIRECT_OPERATOR), "dollar_sign_count": of("$"),
        "subshell_count": c(P.SUBSHELL), "os_path_indicator": test(pay, P.OS_PATH), "distinct_shell_command_count": kinds, "shell_to_path_ratio": kinds / (c(P.TRAVERSAL_SEQUENCE) + of("/\\") + 1),
        "ua_suspicious": test(agent, P.SCANNER_AGENT), "content_type_encoded": test(kind, P.FORM_TYPE),
    }
