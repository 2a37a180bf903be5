"""Validation of telemetry and of canonical requests: valid rows, and reasons for the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions.features import NAMES
from weir.operators.policy import CLASSES

#: The length limit of a source's name and the checks' messages.
MAX_SOURCE = 128
LABELS = (*CLASSES,)


def telemetry_error(width: int = len(NAMES)) -> Column:
    """The first complaint about a telemetry row, or null: vector, predicted_class, confidence, timestamp, source_id."""
    bad = F.lit(False)
    vector = F.col("vector")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checks = [
        (vector.isNotNull() & (F.size(vector) == width), f"vector must be an array of {width} numbers"),
        (finite, "vector must contain only finite numbers"),
        (F.col("predicted_class").isin(*CLASSES), f"predicted_class must be one of {', '.join(CLASSES)}"),
        (F.col("confidence").between(0, 1) & ~F.isnan("confidence"), "confidence must be a number in [0, 1]"),
        (F.col("timestamp") > 0, "timestamp must be a positive number"),
        (F.length("source_id").between(1, MAX_SOURCE), f"source_id must be a non-empty string up to {MAX_SOURCE} characters"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, bad), message) for ok, message in checks])


def split_valid(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error, the latter with the column `error`."""
    d = df.withColumn("error", error)
    return d.where("error is null").drop("error"), d.where("error is not null")


def reason_counts(df: DataFrame, error: Column) -> DataFrame:
    return df.groupBy(F.coalesce(error, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def request_error() -> Column:
    """The first complaint about a canonical request, or null."""
    empty = (F.length(F.coalesce("path", F.lit(""))) + F.length(F.coalesce("query", F.lit(""))) + F.length(F.coalesce("body", F.lit("")))) == 0
    return F.coalesce(
        F.when(F.col("method").isNull() | (F.col("method") == ""), "missing method"), F.when(F.col("path").isNull(), "missing path"), F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "unknown label"), F.when(empty, "empty request")
    )


def contract_errors(columns: list[str], names: list[str] = NAMES) -> list[str]:
    """Feature columns that are missing, or out of order."""
    missing = [n for n in names if n not in columns]
    return [f"missing {n}" for n in missing] or ([] if [c for c in columns if c in set(names)] == list(names) else ["features are out of order"])
