"""Overlap of two sets of short texts by character shingles: exact pairs, saturation, rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.places import materialise

#: Shingle length, similarity of a pair, least text length, and the rate from which an overlap is flagged.
SHINGLE, SIMILARITY, MIN_LENGTH, FLAG_PERCENT = 3, 0.70, 15, 1.0


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """The distinct k-grams of characters; of a shorter text the text itself."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(grams)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def raw_text(body: str = "body", query: str = "query", path: str = "path") -> Column:
    """The first of body, query and path that is not empty."""
    some = lambda c: F.when(F.length(c) > 0, F.col(c))
    return F.coalesce(some(body), some(query), some(path), F.lit(""))


def overlap_pairs(texts: DataFrame, *, id_col: str, text: str, k: int = SHINGLE, least: float = SIMILARITY, min_length: int = MIN_LENGTH) -> DataFrame:
    """a, b, similarity: pairs a < b of distinct texts of Jaccard similarity `least` or more; exact.

    A set of n shingles can only reach it with a set that shares one of its
    n - ceil(least n) + 1 rarest shingles, so texts meet on those; equal texts
    are one row, that of the least id.
    """
    d = texts.where(F.length(text) >= min_length).groupBy(F.col(text).alias("t")).agg(F.min(id_col).alias("id")).withColumn("s", shingles(F.col("t"), k))
    # the same order in every text: rarest first, ties by the shingle
    rank = d.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    keyed = d.select("id", F.size("s").alias("size"), F.explode("s").alias("g")).join(rank, "g").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    keep = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    prefix = keyed.select("id", "size", F.explode(F.slice("o", F.lit(1), keep)).alias("e")).select("id", "size", "e.g")
    met = prefix.alias("x").join(prefix.alias("y"), "g").where((F.col("x.id") < F.col("y.id")) & (F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - 1e-9))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(d.select(F.col("id").alias("a"), F.col("s").alias("p")), "a").join(d.select(F.col("id").alias("b"), F.col("s").alias("q")), "b")
    return both.select("a", "b", jaccard(F.col("p"), F.col("q")).alias("similarity")).where(F.col("similarity") >= least)


def saturation(pairs: DataFrame) -> DataFrame:
    """One row: pairs, texts with a neighbour, and how many neighbours these have."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ends.agg((F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("bigint").alias("pairs"), F.count("*").alias("texts"), F.avg("n").alias("mean_neighbours"), F.max("n").alias("most_neighbours"))


def overlap_with_classes(rows: DataFrame, corpora: DataFrame, *, id_col: str, text: str, label: str, k: int = SHINGLE, least: float = SIMILARITY, min_length: int = MIN_LENGTH) -> DataFrame:
    """label, total, evaluated, excluded, matched, share, flagged, example: how many texts of a file have a near text in each class.

    Texts of less than `min_length` characters are not evaluated; a class is
    flagged when more than `FLAG_PERCENT` percent of the evaluated ones have a
    text of similarity `least` or more in it. `example` begins the matched text
    of the least id. Exact: texts of both sides meet on their rarest shingles, as
    in `overlap_pairs`; equal texts are one row, equal ones of both sides match.
    `corpora` may be a sample (`corpus.sample_per_class`).
    """
    usable = F.length(text) >= min_length
    file_texts = rows.where(usable).groupBy(F.col(text).alias("t")).agg(F.count("*").alias("rows"), F.min(id_col).alias("id"))
    classes = corpora.where(usable & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("t")).distinct()
    d = materialise(file_texts.select("t").unionByName(classes.select("t")).distinct().withColumn("h", F.sha2("t", 256)).withColumn("s", shingles(F.col("t"), k)))
    rank = d.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    keyed = d.select("h", F.size("s").alias("size"), F.explode("s").alias("g")).join(rank, "g").groupBy("h", "size").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("o"))
    keep = (F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).cast("int")
    prefix = materialise(keyed.select("h", "size", F.explode(F.slice("o", F.lit(1), keep)).alias("e")).select("h", "size", "e.g"))
    mine = file_texts.select(F.sha2("t", 256).alias("h")).join(prefix, "h").select(F.col("h").alias("a"), F.col("size").alias("x"), "g")
    theirs = classes.select(F.sha2("t", 256).alias("h")).distinct().join(prefix, "h").select(F.col("h").alias("b"), F.col("size").alias("y"), "g")
    pairs = mine.join(theirs, "g").where(F.least("x", "y") >= least * F.greatest("x", "y") - 1e-9).select("a", "b").distinct()
    both = pairs.join(d.select(F.col("h").alias("a"), F.col("s").alias("p")), "a").join(d.select(F.col("h").alias("b"), F.col("s").alias("q")), "b")
    near = both.where(jaccard(F.col("p"), F.col("q")) >= least).select("a", "b")
    of_class = near.join(classes.select(F.sha2("t", 256).alias("b"), "label"), "b").select("a", "label").distinct()
    hits = of_class.join(file_texts.withColumn("a", F.sha2("t", 256)), "a").groupBy("label").agg(F.sum("rows").alias("matched"), F.substring(F.min_by("t", "id"), 1, 120).alias("example"))
    counts = rows.agg(F.count("*").alias("total"), F.count_if(usable).alias("evaluated"))
    out = corpora.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().join(hits, "label", "left").join(F.broadcast(counts), F.lit(True))
    share = F.when(F.col("evaluated") > 0, F.coalesce("matched", F.lit(0)) / F.col("evaluated")).otherwise(F.lit(0.0))
    return out.select("label", "total", "evaluated", (F.col("total") - F.col("evaluated")).alias("excluded"), F.coalesce("matched", F.lit(0)).alias("matched"), share.alias("share"), (100 * share > FLAG_PERCENT).alias("flagged"), "example")
