"""The decision policy (P13, P14), late patches (ST3 as batch) and canary comparison (M22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes in the order of a model's probabilities, and the two thresholds.
CLASSES = ("benign", "cmdi", "path_traversal", "sqli", "xss")
BLOCK_AT = 0.35
ANOMALY_BELOW = 0.004206


def decide(probabilities: Column, anomaly_score: Column, *, block_at: float = BLOCK_AT, anomaly_below: float = ANOMALY_BELOW) -> Column:
    """struct(verdict, predicted_class, confidence, if_score, is_anomaly).

    The first of equal probabilities wins. Without probabilities the verdict is
    timeout. A confident attack is blocked; else an anomaly passes marked.
    """
    top = F.array_max(probabilities)
    label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position(probabilities, top).cast("int"))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), top))
    anomaly = F.coalesce(anomaly_score < anomaly_below, F.lit(False))
    known = probabilities.isNotNull() & (F.size(probabilities) > 0)
    verdict = F.when(~known, "timeout").when((label != "benign") & (confidence >= block_at), "block").when(anomaly, "pass_anomaly").otherwise("pass")
    return F.struct(
        verdict.alias("verdict"), F.when(known, label).otherwise("benign").alias("predicted_class"), F.when(known, confidence).otherwise(0.0).alias("confidence"),
        F.when(known, F.coalesce(anomaly_score, F.lit(0.0))).otherwise(0.0).alias("if_score"), (known & anomaly).alias("is_anomaly"),
    )


def patch_late(events: DataFrame, replies: DataFrame, *, timeout_ms: int = 50, anomaly_below: float = ANOMALY_BELOW) -> DataFrame:
    """Events with late anomaly scores: `replies` has event_id, if_score, replied_at (ms).

    Replies within the time limit patch score and flag, and turn pass into
    pass_anomaly; blocked events keep their verdict, timed-out ones stay as they
    are. Of several replies the first counts.
    """
    first = replies.groupBy("event_id").agg(F.min(F.struct("replied_at", "if_score")).alias("r")).select("event_id", F.col("r.replied_at").alias("replied_at"), F.col("r.if_score").alias("late"))
    joined = events.join(first, "event_id", "left")
    hit = F.coalesce((F.col("replied_at") - F.col("timestamp") <= timeout_ms) & (F.col("verdict") != "timeout"), F.lit(False))
    anomaly = hit & (F.col("late") < anomaly_below)
    return joined.withColumns({
        "verdict": F.when(anomaly & (F.col("verdict") == "pass"), "pass_anomaly").otherwise(F.col("verdict")),
        "if_score": F.when(hit, F.col("late")).otherwise(F.col("if_score")), "is_anomaly": anomaly, "patched": hit,
    }).drop("late", "replied_at")


def compare_canary(events: DataFrame, canary: DataFrame, on: str = "event_id") -> DataFrame:
    """One comparison per event that a candidate model answered: `canary` has `on` and probabilities.

    A candidate has no anomaly score of its own, so verdicts agree if both block or both do not.
    """
    c = canary.select(on, decide(F.col("probabilities"), F.lit(None).cast("double")).alias("c"))
    return events.join(c, on).select(
        on, "timestamp", F.col("verdict").alias("production_verdict"), F.col("predicted_class").alias("production_class"), F.col("confidence").alias("production_confidence"),
        F.col("c.verdict").alias("canary_verdict"), F.col("c.predicted_class").alias("canary_class"), F.col("c.confidence").alias("canary_confidence"),
        ((F.col("verdict") == "block") == (F.col("c.verdict") == "block")).alias("verdict_match"), (F.col("c.predicted_class") == F.col("predicted_class")).alias("class_match"),
        F.abs(F.col("c.confidence") - F.col("confidence")).alias("confidence_delta"),
    )


#: Methods that a replay sends.
METHODS = ("get", "post", "put", "delete", "patch")


def replay_method(method: Column, body: Column) -> Column:
    """The method by which a recorded request is sent again: POST if it has a body and no method, GET for unsupported ones."""
    raw = F.lower(F.when(F.length(method) > 0, method).when(F.length(body) > 0, "POST").otherwise("GET"))
    return F.when(raw.isin(*METHODS), raw).otherwise("get")
