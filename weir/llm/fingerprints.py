"""Document fingerprints (operator 11), native: bottom-k sketches of shingle hashes.

A text's shingles are its runs of five words, unchanged; a text of fewer words
has its whole sequence as one, an empty or blank one has none. Its sketch is the
`k` least distinct 64-bit hashes of them, ascending. The sketch of a union is the
`k` least hashes of the sketches' union, so sketches of parts merge into that of
the whole, in any order and any grouping. From sketches alone come

* resemblance: the share of the least `k` hashes of the union that both have,
* the number of distinct shingles: exact below `k`, else (k - 1) / (the k-th hash
  as a part of the whole range),
* containment of one in the other: resemblance * size of the union / own size.

Everything is DataFrame functions on arrays inside one row; texts cross one
shuffle, where each meets the next document's first characters and sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weir.llm.common import materialise, table
from weir.llm.quality import let, words_of
from weir.operators.places import numbered

#: Words of a shingle, and hashes of a sketch: the standard error of a resemblance is 0.044 at most.
WORDS, K = 5, 128
#: Digits of a hash in a fingerprint.
DIGITS = 16


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of all shingles of a text, with repeats."""

    def of(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.when(i >= words - 1, F.xxhash64(*[F.get(w, i - j) for j in range(words - 1, 0, -1)], x)))
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= words, F.slice(each, words, F.greatest(F.size(w) - (words - 1), F.lit(1)))).otherwise(whole)

    return let(words_of(F.coalesce(text, F.lit(""))), of)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The `k` least distinct shingle hashes, ascending; all of them, if fewer; null is an empty text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches, 0 for one."""

    def of(u: Column) -> Column:
        last = F.get(u, F.size(u) - 1)
        return F.size(F.filter(F.array_intersect(a, b), lambda h: h <= last)) / F.size(u)

    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(let(union(a, b, k), of))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles; exact where the sketch has fewer than `k`."""
    part = (F.get(s, F.lit(k - 1)).cast("double") + 2.0**63 + 1) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has; 1 for an empty a."""
    whole = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), whole))


def fingerprint(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), DIGITS, "0")), "")


def from_fingerprint(text: Column) -> Column:
    """The sketch of a fingerprint."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) / DIGITS - 1, F.lit(0)).cast("int")), lambda i: F.substr(text, i * DIGITS + 1, F.lit(DIGITS)))
    high = lambda p: F.conv(F.substr(p, F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    low = lambda p: F.conv(F.substr(p, F.lit(9), F.lit(8)), 16, 10).cast("bigint")
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(pieces, lambda p: F.shiftleft(high(p), 32).bitwiseOR(low(p))))


def merged(parts: DataFrame, by: str, column: str = "sketch", k: int = K) -> DataFrame:
    """by, sketch: one sketch for each group of rows, from their sketches alone.

    Hashes are made distinct before they are shuffled, and each task keeps only
    the `k` least of a group, so a group of a third of all rows is no one's load.
    Groups whose sketches are all empty or null have an empty one; the null group
    is one group.
    """
    hashes = parts.select(by, F.explode(column).alias("_h")).distinct()
    least = hashes.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_h"))).where(F.col("_n") <= k)
    some = least.groupBy(F.col(by).alias("_by")).agg(F.sort_array(F.collect_list("_h")).alias("sketch"))
    groups = parts.select(by).distinct()
    return groups.join(some, groups[by].eqNullSafe(some["_by"]), "left").select(by, F.coalesce("sketch", F.array().cast("array<bigint>")).alias("sketch"))


def following(rows: DataFrame) -> tuple[DataFrame, bool]:
    """key, quarter, before, wanted: each distinct document (doc_id, text) with a fourth of its length, and the key and fourth of the one before it; and whether any is repeated.

    `rows` has doc_id, _text and _key. The first comes after the last. Only ids,
    hashes and lengths are ordered, never texts.
    """
    ids = rows.groupBy("doc_id", "_key", F.floor(F.length("_text") / 4).alias("quarter")).agg(F.count("*").alias("copies"))
    placed = materialise(numbered(ids, "doc_id", "_key", name="_at"))
    n, copies = placed.agg(F.max("_at"), F.max("copies")).first()
    here = placed.select("_key", "_at")
    before = placed.select(F.col("_key").alias("before"), F.col("quarter").alias("wanted"), (F.col("_at") % F.lit(n or 1) + 1).alias("_at"))
    return here.join(before, "_at").drop("_at"), (copies or 0) > 1


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id, distinct_shingles.

    A document's edited text has the last fourth of its characters replaced by
    the first ones of the next document. Documents are ordered by id, null first,
    and of one id by the text's hash; rows of equal id and text are one document
    in that order and each get its result. The first comes after the last, so a
    single document is its own next. Null texts are empty, texts of any length
    are whole, extra columns are left alone, an empty table gives an empty one.
    Two empty texts resemble each other by 1, an empty and another by 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.concat_ws(":", F.col(id_col).cast("string"), F.hex(F.xxhash64(text))).alias("_key"))
    order, repeated = following(rows)
    # both sides read the same columns of the same shuffle
    full = rows.join(order.hint("merge"), "_key")
    first = full.select(
        F.col("before").alias("_key"), F.col("doc_id").alias("next_id"), F.substr("_text", F.lit(1), F.col("wanted").cast("int")).alias("_first"), sketch(F.col("_text"), k, words).alias("_next"),
    )
    if repeated:
        first = first.dropDuplicates(["_key"])
    own = full.select("_key", "doc_id", "_text", F.length("_text").alias("_n"))
    kept = F.substr("_text", F.lit(1), (F.col("_n") - F.floor(F.col("_n") / 4)).cast("int"))
    both = own.join(first.hint("merge"), "_key").select("doc_id", "next_id", "_n", "_text", "_next", F.concat(kept, "_first").alias("_edited"))
    known = both.select("doc_id", "next_id", "_n", "_next", F.sha2("_edited", 256).alias("edited_sha256"), sketch(F.col("_text"), k, words).alias("_own"), sketch(F.col("_edited"), k, words).alias("_new"))
    return known.select(
        "doc_id", F.col("_n").cast("bigint").alias("n_chars"), "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_new"), k).alias("near_edited"), resemblance(F.col("_own"), F.col("_next"), k).alias("near_next"),
        "next_id", distinct_shingles(F.col("_own"), k).alias("distinct_shingles"),
    )


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
