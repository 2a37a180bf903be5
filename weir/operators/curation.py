"""Curated telemetry: vectors of clusters' members, decisions on clusters, curated rows, and what they trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.features import NAMES
from weir.operators.policy import CLASSES

#: The name of curated rows' source, and how many of them start a new training.
SOURCE, MIN_ROWS = "mlops_telemetry_curated", 50


def parse_vector(text: Column) -> Column:
    """An array of numbers from its JSON text; null where it is none."""
    return F.from_json(text, "array<double>")


def vector_hash(vector: Column, label: Column) -> Column:
    """sha256 of the numbers joined by commas, a bar and the label; whole numbers are written without a point."""
    number = lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return F.sha2(F.concat(F.array_join(F.transform(vector, number), ",", "null"), F.lit("|"), label), 256)


def curate(assigned: DataFrame, decisions: DataFrame, vectors: DataFrame, names: list[str] = NAMES) -> DataFrame:
    """Feature rows of the members of labelled clusters, with label, _source and _row_hash.

    `assigned` has cluster and id, `decisions` cluster and label (null or an
    unknown class: the cluster is discarded), `vectors` id and vector. Members
    without a vector are left out. A cluster of any size is rows, never one array.
    """
    kept = decisions.where(F.col("label").isin(*CLASSES)).select("cluster", "label")
    d = assigned.join(kept, "cluster").join(vectors.select("id", "vector"), "id").where("vector is not null")
    columns = [F.get("vector", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return d.select("id", *columns, "label", F.lit(SOURCE).alias("_source"), vector_hash(F.col("vector"), F.col("label")).alias("_row_hash"))


def merge_curated(corpus: DataFrame, curated: DataFrame) -> DataFrame:
    """The corpus and curated rows that it does not have, one of each hash; number columns that one side lacks are 0."""
    from weir.operators.corpus import backfill_union

    new = curated.dropDuplicates(["_row_hash"]).join(corpus.select("_row_hash").distinct(), "_row_hash", "left_anti")
    return backfill_union(corpus, new)


def training_due(curated: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """One row: curated rows, and whether they are enough for a new training."""
    return curated.agg(F.count("*").alias("rows"), (F.count("*") >= least).alias("due"))


def latest(paths: DataFrame, column: str = "path", pattern: str = r"(^|/)cluster_report_[^/]*\.json$") -> DataFrame:
    """The last report by file name; no row if there is none."""
    found = paths.where(F.col(column).rlike(pattern))
    return found.agg(F.max_by(column, F.struct(F.substring_index(column, "/", -1), F.col(column))).alias(column)).where(F.col(column).isNotNull())


def zero_rows(features: DataFrame, column: str = "payload_length") -> DataFrame:
    """One row: rows, those with a 0 in the column, and their percentage."""
    zero = F.count_if(F.col(column) == 0)
    return features.agg(F.count("*").alias("rows"), zero.alias("zero"), F.when(F.count("*") > 0, 100.0 * zero / F.count("*")).alias("percent"))
