"""The 76 request features, in their order.

The texts that may be the payload (the body's form values, body, query and path) and
their decoded forms are column expressions. One UDF over Arrow batches (`scan`) scores
them, chooses the payload and searches it; lengths, methods and headers are column
expressions again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from weir.functions import patterns as P
from weir.functions import scan
from weir.functions.text import count, decode_component, form_values, let, may_decode, normalise

#: Names of the features, group by group, in the order of the vector.
GROUPS = {
    "lengths": ["payload_length", "payload_entropy", "uri_length", "path_length", "query_string_length", "body_length", "body_entropy", "path_depth", "query_param_count", "fragment_present"],
    "composition": ["special_char_ratio", "numeric_char_ratio", "uppercase_ratio", "whitespace_count", "newline_char_count", "null_byte_count", "extended_ascii_ratio", "payload_token_count"],
    "encoding": ["url_encoded_ratio", "encoded_char_freq", "double_encoded_count", "hex_escape_count", "unicode_escape_count", "html_entity_count", "base64_like_count"],
    "sqli": ["sqli_keyword_count", "sqli_keyword_density", "sqli_comment_count", "sqli_operator_count", "non_form_operator_count", "quote_count", "non_json_quote_count", "semicolon_count", "parenthesis_count", "union_present", "select_present"],
    "xss": ["xss_marker_count", "xss_marker_density", "html_tag_count", "script_tag_present", "js_event_handler_count", "javascript_url_count", "html_entity_density", "alert_function_present", "inline_style_present"],
    "traversal": ["traversal_sequence_count", "path_separator_count", "absolute_path_indicator", "sensitive_file_target", "sensitive_extension_count", "file_extension_suspicious", "dotdot_encoded_count"],
    "command": ["pipe_count", "backtick_count", "shell_command_count", "command_separator_count", "redirect_operator_count", "dollar_sign_count", "subshell_count", "os_path_indicator", "distinct_shell_command_count", "shell_to_path_ratio"],
    "http": ["method_is_get", "method_is_post", "ua_present", "ua_length", "ua_suspicious", "content_type_encoded", "authorization_length", "unusual_headers_count", "status_code"],
    "temporal": ["req_count_1s", "req_count_5s", "req_count_60s", "error_rate_4xx_60s", "endpoint_diversity_60s"],
}
NAMES = [name for group in GROUPS.values() for name in group]
#: Request columns and their defaults.
DEFAULTS = {"method": "", "path": "", "query": "", "body": "", "user_agent": "", "content_type": "", "referer": "", "cookie": "", "status_code": 0}


def canonical(df: DataFrame) -> DataFrame:
    """The request columns with defaults for nulls and for missing columns; other columns stay."""
    new = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in DEFAULTS.items()}
    empty = F.create_map().cast("map<string,string>")
    new["extra_headers"] = F.coalesce(F.col("extra_headers"), empty) if "extra_headers" in df.columns else empty
    return df.withColumns(new)


#: Features that need a search of texts; the others come from lengths, counts of one character and the request's columns.
SEARCHED = [n for g in ("lengths", "composition", "encoding", "sqli", "xss", "traversal", "command", "http") for n in GROUPS[g] if n not in (*GROUPS["lengths"][2:6], *GROUPS["lengths"][7:], "method_is_get", "method_is_post", "ua_present", "ua_length", "authorization_length", "unusual_headers_count", "status_code")]


def with_offer(df: DataFrame) -> DataFrame:
    """Canonical requests with `_offer`, four lists of one length.

    The first has the body, the query, the path and the body's form values; the others have
    these decoded once, fully, and both, null where that changes nothing.
    """
    fields = [F.col(c) for c in ("body", "query", "path")]
    df = canonical(df).withColumn("_texts", F.concat(F.array(*fields), F.coalesce(form_values(F.col("body")), F.array().cast("array<string>"))))
    some = lambda f: f(fields[0]) | f(fields[1]) | f(fields[2])
    same = F.array_repeat(F.lit(None).cast("string"), F.size("_texts"))
    # most requests have nothing to decode, and are told by a look outside the lists
    each = lambda found, f: F.when(found, F.transform("_texts", f)).otherwise(same)
    percent = some(lambda c: F.contains(c, F.lit("%")))
    both = lambda t: let(F.nullif(decode_component(t), t), lambda o: F.when(o.isNotNull(), normalise(o)))
    once, full = each(percent, lambda t: F.nullif(decode_component(t), t)), each(some(may_decode), lambda t: F.nullif(normalise(t), t))
    # a bare array would be taken apart by its readers, a concatenation is computed as one
    offer = F.concat(F.array("_texts", once), F.array(full, each(percent, both)))
    return df.withColumn("_offer", offer).drop("_texts")


#: The offer has to be computed below the UDFs: nested functions of lists are not evaluated among their arguments.
#: So they name it twice (it is sent once), which keeps a projection from moving there, and are marked as not
#: deterministic, which keeps conditions on their results above them.
OFFER = ("_offer", "_offer")


def chosen(offer: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Where each request's texts begin, in all end to end, where its payload is, and the texts with their decoded forms."""
    lists = offer.flatten()
    lists = [lists.take(pa.array(np.arange(i, len(lists), 4))) for i in range(4)]
    sizes, forms = scan.numbers(pc.list_value_length(lists[0])), [x.flatten() for x in lists]
    return np.cumsum(sizes) - sizes, scan.choose(sizes, *forms), forms


@F.arrow_udf(IntegerType())
def place_of_payload(offer: pa.Array, _: pa.Array) -> pa.Array:
    starts, place, _ = chosen(offer)
    return pa.array(place - starts, pa.int32())


@F.arrow_udf(StructType([StructField(n, DoubleType()) for n in SEARCHED]))
def searched(offer: pa.Array, _: pa.Array, agent: pa.Array, kind: pa.Array) -> pa.Array:
    """The features of the payload that is chosen from each offer."""
    starts, place, (text, _, full, _) = chosen(offer)
    payload, decoded = text.take(pa.array(place)), pc.coalesce(full, text).take(pa.array(place))
    body, query, path = (text.take(pa.array(starts + i)) for i in range(3))
    # a path that stands for want of another is not absolute by its first slash
    only = pc.and_(pc.equal(payload, path), pc.and_(pc.equal(body, ""), pc.equal(query, "")))
    traversal = pc.if_else(only, pc.replace_substring_regex(payload, "^/", ""), payload)
    found = scan.marks(payload, decoded, traversal, body, agent, kind)
    return pa.StructArray.from_arrays([pa.array(found[n].astype(np.float64)) for n in SEARCHED], SEARCHED)


def with_payload(df: DataFrame) -> DataFrame:
    """Canonical requests with `payload`: of body, query and path the one that scores highest, in this order on ties.

    The form value of the highest positive score stands for the body, the first of equals.
    """
    return with_offer(df).withColumn("_at", place_of_payload.asNondeterministic()(*OFFER)).withColumn("payload", F.get(F.col("_offer")[0], F.col("_at"))).drop("_at", "_offer")


def feature_columns(marks: Column) -> dict[str, Column]:
    """Features of canonical requests with their offer; `marks` is the struct of those that need a search."""
    body, query, path = F.col("body"), F.col("query"), F.col("path")
    uri = F.when(F.length(query) > 0, F.concat(path, F.lit("?"), query)).otherwise(path)
    breaks = r"\n\r\x{2028}\x{2029}"
    before = F.when(uri.rlike(f"[{breaks}]"), F.regexp_replace(uri, rf"\?[^{breaks}]*\z", "")).otherwise(F.substring_index(uri, "?", 1))
    own = {
        "uri_length": F.length(uri), "path_length": F.length(before), "query_string_length": F.length(query), "body_length": F.length(body), "path_depth": count(before, "/"),
        "query_param_count": count(query, "&") + (F.length(query) > 0).cast("int"), "fragment_present": (F.instr(uri, "#") > 0).cast("int"),
        "method_is_get": (F.upper("method") == "GET").cast("int"), "method_is_post": (F.upper("method") == "POST").cast("int"), "ua_present": (F.length("user_agent") > 0).cast("int"), "ua_length": F.length("user_agent"),
        "authorization_length": F.length(F.coalesce(F.try_element_at("extra_headers", F.lit("authorization")), F.lit(""))),
        "unusual_headers_count": F.when(F.size("extra_headers") > 0, F.size(F.filter(F.map_keys("extra_headers"), lambda k: ~F.lower(k).isin(*P.STANDARD_HEADERS)))).otherwise(0), "status_code": F.col("status_code"),
    } | {n: F.lit(0) for n in GROUPS["temporal"]}
    return {n: own[n].cast("double") if n in own else marks[n] for n in NAMES}


def extract(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Requests to the columns in `keep` and the 76 features, as doubles.

    Temporal features are 0 here; `temporal_features` has them for logs. Lengths
    count code points. Null fields have their defaults, so that no feature is null.
    Conditions on columns in `keep` are best put on `df`: they are not pushed through.
    """
    d = with_offer(df.withColumns({f"_keep_{c}": F.col(c) for c in keep}))
    d = d.withColumn("_marks", searched.asNondeterministic()(*OFFER, "user_agent", "content_type"))
    return d.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *[v.alias(n) for n, v in feature_columns(F.col("_marks")).items()])


# Names that both models leave out, and those that only the anomaly model does.
MODEL_DROPS = ("status_code", "req_count_1s", "req_count_5s", "req_count_60s", "error_rate_4xx_60s", "endpoint_diversity_60s", "non_json_quote_count")
ANOMALY_DROPS = ("dotdot_encoded_count", "authorization_length", "unusual_headers_count", "null_byte_count", "os_path_indicator", "sensitive_file_target")
CLASSIFIER_NAMES = [n for n in NAMES if n not in MODEL_DROPS]
ANOMALY_NAMES = [n for n in CLASSIFIER_NAMES if n not in ANOMALY_DROPS]
