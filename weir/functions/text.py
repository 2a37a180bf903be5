"""Column functions for request text: decoding, entropy, tokens, payload selection helpers."""

from __future__ import annotations

import html
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from weir.functions import patterns as P


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row and not again for each mention."""
    return F.transform(F.array(value), body)[0]


def count(text: Column, pattern: str) -> Column:
    """The number of matches; those of single characters by what is left without them, without a list of matches."""
    if pattern in P.CHARACTERS:
        characters = P.CHARACTERS[pattern]
        if len(characters) <= 2:
            rest = text
            for c in characters:
                rest = F.replace(rest, F.lit(c), F.lit(""))
            return F.octet_length(text) - F.octet_length(rest)
        return F.length(text) - F.length(F.translate(text, characters, ""))
    return where_possible(text, pattern, F.regexp_count(text, F.lit(P.for_java(pattern))))


def test(text: Column, pattern: str) -> Column:
    return where_possible(text, pattern, text.rlike(P.for_java(pattern)).cast("int"))


def where_possible(text: Column, pattern: str, found: Column) -> Column:
    """`found`, or 0 where the text has nothing that a match must hold: most texts have few of these, and looking for them is cheap."""
    if pattern not in P.NEEDS:
        return found
    return F.when(text.isNull() | reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in P.NEEDS[pattern]]), found).otherwise(0)


def decode_component(text: Column) -> Column:
    """Strict percent decoding: + stays; any malformed escape or invalid UTF-8 leaves the whole text."""

    def body(s: Column) -> Column:
        d = F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
        return let(d, lambda x: F.when(x.isNull() | ((F.instr(x, "�") > 0) & (F.instr(s, "�") == 0)), s).otherwise(x))

    return F.when(F.instr(text, "%") > 0, let(text, body)).otherwise(text)


def decode_form(text: Column) -> Column:
    """Lenient form decoding: + is a blank, malformed escapes stay as they are."""
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9a-fA-F]{2})", "%25"))


def _code_unit(code: Column) -> Column:
    """The UTF-16 unit of a number, modulo 2^16."""
    return F.decode(F.unhex(F.lpad(F.hex(F.pmod(code, F.lit(65536))), 4, "0")), "UTF-16BE")


def _replace_codes(text: Column, pattern: str, number) -> Column:
    """Each match of the pattern's group becomes its character."""

    def body(s: Column) -> Column:
        parts, codes = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
        return F.array_join(F.zip_with(parts, codes, lambda p, c: F.concat(p, F.when(c.isNull(), "").otherwise(_code_unit(number(c))))), "")

    return F.when(text.rlike(pattern), let(text, body)).otherwise(text)


#: The named entities that are decoded, in order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"))


def decode_entities(text: Column) -> Column:
    for name, character in ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", character)
    decimal = lambda c: F.coalesce(F.try_to_number(F.right(c, F.lit(15)), F.lit("9" * 15)).cast("bigint"), F.lit(0).cast("bigint"))
    text = _replace_codes(text, r"&#(\d+);", decimal)
    return _replace_codes(text, r"(?i)&#x([0-9a-f]+);", lambda c: F.conv(F.right(c, F.lit(4)), 16, 10).cast("bigint"))


def decode_escapes(text: Column) -> Column:
    return _replace_codes(text, r"\\u([0-9a-fA-F]{4})", lambda c: F.conv(c, 16, 10).cast("bigint"))


def may_decode(text: Column) -> Column:
    """Whether the text has anything that `normalise` may change."""
    return text.rlike(r"%|\\u|&(?:#|(?i:lt|gt|amp|quot);)")


def normalise(text: Column, rounds: int = 5) -> Column:
    """Percent, entity and escape decoding repeated until nothing changes, `rounds` times at most."""
    entities = lambda s: F.when(F.contains(s, F.lit("&")), decode_entities(s)).otherwise(s)
    escapes = lambda s: F.when(F.contains(s, F.lit("\\u")), decode_escapes(s)).otherwise(s)
    step = lambda s: let(let(decode_component(s), entities), escapes)
    again = lambda a: F.when(a["same"], a).otherwise(let(step(a["s"]), lambda n: F.struct(n.alias("s"), (n == a["s"]).alias("same"))))
    loop = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(text.alias("s"), F.lit(False).alias("same")), lambda a, _: again(a), lambda a: a["s"])
    return F.when(may_decode(text), loop).otherwise(text)


def tokens(text: Column) -> Column:
    """The number of runs without white space."""
    return F.regexp_count(text, F.lit(f"[^{P.SPACE_CLASS}]+"))


@F.pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the UTF-8 bytes, -sum p log2(p + 1e-12); 0 for empty text."""

    def one(text) -> float:
        if not text:
            return 0.0
        n = np.bincount(np.frombuffer(text.encode(), np.uint8))
        p = n[n > 0] / n.sum()
        return float(-(p * np.log2(p + 1e-12)).sum())

    return texts.map(one).astype("float64")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All character references of a text, as HTML has them."""
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


def decode_text(text: Column) -> Column:
    """Character references, then percent escapes; + stays, malformed escapes too."""
    return decode_form(F.replace(unescape(text), F.lit("+"), F.lit("%2B")))


def form_values(body: Column) -> Column:
    """Values of a urlencoded form, the last of each key at its first place; null unless it has two keys.

    One leading ? is dropped; a body without = is no form.
    """

    def fields(body: Column) -> Column:
        pieces = F.filter(F.split(F.regexp_replace(body, r"^\?", ""), "&"), lambda x: x != "")
        return F.transform(pieces, lambda x: F.struct(decode_form(F.substring_index(x, "=", 1)).alias("k"), F.when(F.instr(x, "=") > 0, decode_form(x.substr(F.instr(x, "=") + 1, F.length(x)))).otherwise("").alias("v")))

    def last(f: Column) -> Column:
        keys = F.array_distinct(F.transform(f, lambda x: x["k"]))
        return F.when(F.size(keys) > 1, F.transform(keys, lambda k: F.element_at(F.filter(f, lambda x: x["k"] == k), -1)["v"]))

    return F.when(F.instr(body, "=") > 0, let(fields(body), last))


def subnet(ip: Column) -> Column:
    """The /24 of an IPv4 address; other text as it is."""
    return F.when(ip.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))).otherwise(ip)


def next_version(name: Column) -> Column:
    """The name with its last number one higher; null without a number at the end."""
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits != "", F.concat(F.regexp_replace(name, r"\d+$", ""), (digits.cast("bigint") + 1).cast("string")))
