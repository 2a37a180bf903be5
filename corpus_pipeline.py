"""The corpus pipeline over `documents`, stage by stage.

quality rules -> n-gram Jaccard join -> substring dedup -> mixing -> packing.
A stage is a function of (spark, docs, sf_dir). All but the last return the
columns that they got; the last one returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import jaccard, mixing, packing, quality, substring
from weir.llm.common import materialise


def numbered(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """The documents with doc_id, text and source under their names and all columns under numbers; the numbers, and the columns that they bring back.

    An operator's figures so never meet a column of the documents that has their name.
    """
    names = tuple(f"column_{i}" for i in range(len(docs.columns)))
    used = [docs[c] for c in ("doc_id", "text", "source") if c in docs.columns]
    carried = [docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names, strict=True)]
    return docs.select(*used, *carried), names, [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go; all others keep all their columns.

    Null, empty and short texts fail the base rules. A null id is never trusted.
    Repeated rows are judged each, and alike; texts of any length are whole.
    Columns of any name are carried. An empty table gives an empty table.
    """
    d, names, back = numbered(docs)
    return quality.quality(d, quality.trusted_ids(spark, sf_dir), carry=names).where("kept").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the least id stays.

    Documents without an id stay; so do all different texts of that id. Of rows of
    equal id and text one stays, the least of their other columns as JSON. Null
    and empty texts are alike to nothing. An empty table gives an empty table.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    d, names, back = numbered(docs)
    d = d.select("doc_id", "text", F.struct(*names).alias("row"))
    kept = d.join(first, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(d.where("doc_id is null")).select("row.*").select(*back)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that start in an earlier document go; so do documents of which nothing is left.

    A changed text is its kept words joined by blanks, and n_chars, if there is
    one, its new length; other rows stay as they are, with null and empty texts
    and those without an id. Rows that share an id count as one document. An
    empty table gives an empty table.
    """
    d, names, back = numbered(docs)
    out = substring.remove_repeats(d, carry=names).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    changed = [F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(n)).alias(c) if c in new else b for c, n, b in zip(docs.columns, names, back, strict=True)]
    return out.select(*changed)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it does not take go.

    Null sources are one source, the last. Documents without words take nothing
    and go. Rows without an id, of one id, and equal rows are mixed each. An empty
    table gives an empty table.
    """
    d, names, back = numbered(docs)
    taken = mixing.mix_documents(d, carry=names).where("taken > 0")
    copies = F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))
    return taken.select(copies, *[F.col(f"carried_{n}").alias(n) for n in names]).select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece of a document.

    A null or empty text is its end token alone. Rows without an id, of one id,
    and equal rows are packed each. Other columns are left alone; an empty table
    gives an empty table.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", source_mix),
    ("packing", packed),
]

#: Hashed counters and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
