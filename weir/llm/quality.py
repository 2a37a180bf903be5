"""Quality rules (operator 3), native: hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to counters of their own, both powers of two
that grow with the input: those of words with the number of distinct words, those
of pairs with the square root of the number of words. So a word, which says most,
shares its counter with a bounded number of others at every size, while the
counts of pairs stay small enough to be summed in part before they are shuffled.
Two multinomials over the counters are estimated: one from all trusted documents,
one from all documents. A document's score is the mean over its n-grams of
log(trusted / raw); it is kept if base rules pass and the score reaches a fixed
threshold, so the verdict on a text depends on the tables alone, never on chance
or order of rows.

Everything is DataFrame functions. The counts are partial sums per task. Up to
`BROADCAST_COUNTERS` the weights come back as one array, as a scalar subquery, so
that scoring neither shuffles nor moves a text. Beyond, n-grams meet their
weights by a shuffle on the counter; the most frequent counters are broadcast.

The base figures work on arrays inside one row. `let` binds an array once for a
lambda; without it the optimiser may put its whole computation into the lambda
and do it again for each element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import WORD_RE, materialise, table

#: The least number of counters of words and of pairs each; distinct words from which a
#: counter is one too few; counters of pairs for the square root of the number of words.
BUCKETS, PER_COUNTER, PAIRS = 1 << 16, 4, 32
#: Up to so many weights are one array (64 MB); more are joined by a shuffle.
BROADCAST_COUNTERS = 1 << 23
#: Counters of more n-grams than this, and than this share of all, are broadcast in that join: at most 65,536.
HOT, HOT_SHARE = 1 << 16, 1 / (1 << 16)
#: Copies of a text are spread over so many keys of that join.
SPREAD = 16
BLOCK = 1024
#: Pseudo-counts drawn from the raw multinomial: a counter of which the trusted
#: side expects few n-grams says little.
SMOOTHING = 5.0
THRESHOLD = -0.09
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Up to so many trusted ids are sent to every executor (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, characters: str, instead: str = "") -> Column:
    """text with each of the characters replaced; plain byte replacement, no regular expression."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def words_of(text: Column) -> Column:
    """The words of a text: white space becomes blanks, then a split at one character."""
    return F.array_remove(F.split(without(text, SPACES[1:], " "), " "), "")


def ngrams(words: Column, buckets: tuple[int, int]) -> Column:
    """The counters of all words, then of all word pairs, which come after those of words."""
    of, pairs_of = buckets
    single = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(of)).cast("int"))
    pairs = F.transform(words, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(words, i - 1), x), F.lit(pairs_of)).cast("int") + of))
    return F.concat(single, F.filter(pairs, lambda x: x.isNotNull()))


def counters(docs: DataFrame, *, text_col: str = "text", least: int = BUCKETS, per_counter: int = PER_COUNTER, pairs: int = PAIRS) -> tuple[int, int]:
    """Powers of two, `least` or more: with at most about `per_counter` distinct words a counter; `pairs` times the root of the number of words.

    Distinct words are counted by HyperLogLog over all texts, which does not
    depend on the order of rows.
    """
    words = F.explode(F.transform(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.xxhash64(x)))
    distinct, n = docs.select(words.alias("w")).agg(F.approx_count_distinct("w"), F.count("*")).first()

    def power(wanted: float) -> int:
        out = least
        while out < wanted:
            out *= 2
        return out

    return power(distinct / per_counter), power(pairs * n**0.5)


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are sorted by a 64-bit hash; equal neighbours are repeated ones.
    """
    windows = F.filter(
        F.transform(words, lambda x, i: F.struct(F.when(i > 1, F.xxhash64(F.get(words, i - 2), F.get(words, i - 1), x)).alias("h"), i.alias("i"))),
        lambda s: s["h"].isNotNull(),
    )
    hashes = lambda s: F.transform(s, lambda x: x["h"])

    def marked(s: Column) -> Column:
        again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | ((x["h"] == F.get(s, j + 1)["h"])))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"] - 2, x["i"] - 1, x["i"])))))

    return let(windows, lambda s: F.when(F.size(F.array_distinct(hashes(s))) == F.size(s), F.lit(0)).otherwise(let(F.sort_array(s), marked)))


def base_figures(docs: DataFrame, text_col: str = "text") -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = lambda characters: F.octet_length(text) - F.octet_length(without(text, characters))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    return [
        (F.length(text) - found(SPACES)).cast("bigint").alias("word_chars"),
        found(SYMBOLS).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ]


def weights(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: tuple[int, int] = (BUCKETS, BUCKETS), smoothing: float = SMOOTHING) -> DataFrame:
    """b, raw, weight: log(trusted / raw) of each counter that occurs.

    Both counts are compared on the trusted side's scale, where `smoothing`
    n-grams are added in the raw proportion; an unseen counter weighs 0.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    d = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(ids, F.col("_doc") == F.col("_id"), "left")
    grams = let(words_of(F.col("_text")), lambda w: ngrams(w, buckets))
    counted = materialise(
        d.select(F.col("_id").isNotNull().cast("bigint").alias("t"), F.explode(grams).alias("b"))
        .groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
    )
    all_raw, all_trusted = counted.agg(F.sum("raw"), F.sum("trusted")).first()
    expected = F.col("raw") * (all_trusted or 0) / max(all_raw or 0, 1)
    return counted.select("b", "raw", F.log((F.col("trusted") + smoothing) / (expected + smoothing)).alias("weight"))


def as_array(learnt: DataFrame, buckets: int) -> DataFrame:
    """One row, one array: the weight of each counter by its number, put together from blocks."""
    every = learnt.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(learnt, "b", "left").fillna(0.0, ["weight"])
    block = F.sort_array(F.collect_list(F.struct("b", "weight")))
    blocks = every.groupBy(F.floor(F.col("b") / BLOCK).cast("int").alias("k")).agg(F.transform(block, lambda x: x["weight"]).alias("w"))
    return blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"])).alias("weights"))


def scores(keyed: DataFrame, learnt: DataFrame, buckets: tuple[int, int]) -> DataFrame:
    """_k, score of texts (_k, _text): the mean weight of the n-grams under a key, by a shuffle on the counter.

    Copies of a text under one key leave its mean as it is. Counters that many
    n-grams share are broadcast, so none is a hot key of the join.
    """
    learnt = materialise(learnt)
    total = learnt.agg(F.sum("raw")).first()[0] or 0
    hot = F.col("raw") > max(HOT, int(total * HOT_SHARE))
    grams = keyed.select("_k", F.explode(let(words_of(F.coalesce("_text", F.lit(""))), lambda w: ngrams(w, buckets))).alias("b"))
    often, rest = F.broadcast(learnt.where(hot).select("b", "weight")), learnt.where(~hot).select("b", "weight")
    part = lambda d: d.groupBy("_k").agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    both = part(grams.join(often, "b")).unionByName(part(grams.join(often.select("b"), "b", "left_anti").join(rest.hint("merge"), "b")))
    return both.groupBy("_k").agg((F.sum("s") / F.sum("n")).alias("score"))


def quality(
    docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: tuple[int, int] | None = None, threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, base figures, base_failed, score, kept, and the columns named in `carry`.

    `trusted` has the ids of trusted documents; extra columns are left alone. A
    null text has no words, fails the base rules and scores 0; so does an empty
    one. Repeated rows are judged each, and alike. Without any trusted document
    all weights are small and nearly alike; an empty table gives an empty table.
    A text of any length is one array of words within one task, never cut.
    The numbers of counters (words, pairs) follow from the texts unless `buckets` gives them.
    """
    buckets = counters(docs, text_col=text_col) if buckets is None else buckets
    learnt = weights(docs, trusted, id_col=id_col, text_col=text_col, buckets=buckets)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in carry])
    local = sum(buckets) <= BROADCAST_COUNTERS
    if local:
        d = d.withColumn("_w", as_array(learnt, sum(buckets)).scalar())
    else:
        text = F.coalesce("_text", F.lit(""))
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
        d = d.withColumn("_k", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), spread.alias("c")))
        d = d.join(scores(d.select("_k", "_text"), learnt, buckets).withColumnRenamed("score", "_score"), "_k", "left").fillna(0.0, ["_score"])

    def of(words: Column) -> Column:
        if local:
            grams = ngrams(words, buckets)
            score = let(grams, lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(F.col("_w"), b)) / F.size(g)).otherwise(F.lit(0.0)))
        else:
            score = F.col("_score")
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeat_words(words).cast("bigint").alias("n_repeat_words"), score.alias("score"))

    found = let(words_of(F.coalesce("_text", F.lit(""))), of)
    # beside the partition's number all is computed once: a filter on the verdict is not moved below it, to compute it again
    d = d.select("*", F.struct(found.alias("f"), F.spark_partition_id().alias("p")).alias("_f"))
    failed = (F.col("_f.f.n_words") < min_words) | (100 * F.col("_f.f.n_repeat_words") > max_repeat_percent * F.col("_f.f.n_words"))
    return d.select(
        "doc_id", "_f.f.n_words", *base_figures(d, "_text"), "_f.f.n_repeat_words", failed.alias("base_failed"), "_f.f.score",
        (~failed & (F.col("_f.f.score") >= threshold)).alias("kept"), *[F.col(f"_keep_{c}").alias(c) for c in carry if c != id_col],
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
