"""Sinks: feature files, event log, promotion log, notifications."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.features import ANOMALY_NAMES


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV with doubled quotes, as the feature files have it."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: str) -> int:
    """Rewrites CSV as Parquet and returns the rows; raises if rows or columns differ after the round trip."""
    d = spark.read.option("header", True).option("escape", '"').schema(schema).csv(source)
    d.write.mode("overwrite").parquet(target)
    back = spark.read.parquet(target)
    if back.columns != d.columns or (n := back.count()) != d.count():
        raise ValueError("the Parquet file does not match its source")
    return n


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    rows.write.mode("append").json(path)


def latest_events(log: DataFrame, key: str = "event_id", version: str = "version") -> DataFrame:
    """Of an append-only log with patched rows the last version of each event."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), version).alias("_r")).select("_r.*")


#: Addresses of one page of a notification.
PAGE = 1000


def notify(rows: DataFrame, registry: DataFrame, send: Callable[[str, str], None], page: int = PAGE) -> None:
    """Sends each incident as JSON to every active address; a failed sending is not fatal to the batch.

    The registry is read anew for each batch, page by page, however many
    addresses it has; sending happens in the tasks. The incidents are computed
    once and kept until all pages are sent.
    """
    incidents = rows.where(F.col("verdict").isin("block", "pass_anomaly")).select(F.to_json(F.struct("*")).alias("value")).persist()
    active = registry.where("status = 'active'").select("url").distinct()
    pages = max(1, -(-active.count() // page))

    for k in range(pages):
        urls = [r.url for r in active.where(F.pmod(F.xxhash64("url"), F.lit(pages)) == k).collect()]

        def post(part, urls=urls):
            for r in part:
                for url in urls:
                    try:
                        send(url, r.value)
                    except OSError:
                        continue

        if urls:
            incidents.foreachPartition(post)
    incidents.unpersist()


def send_telemetry(rows: DataFrame, url: str, send: Callable[[str, str], None], names: list[str] = ANOMALY_NAMES) -> None:
    """Sends of each row the vector and what a collector asks for, never a request's text; failures are passed over."""
    vector = F.array(*[F.col(n).cast("double") for n in names])
    body = F.to_json(F.struct(vector.alias("vector"), "predicted_class", "confidence", "timestamp", "source_id"))

    def post(part):
        for r in part:
            try:
                send(url, r.value)
            except OSError:
                continue

    rows.select(body.alias("value")).foreachPartition(post)


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines or as CSV with a header."""
    if kind == "csv":
        write_csv(report, path)
    else:
        report.write.mode("overwrite").json(path)


class Registry:
    """Notification addresses as an append-only log of Parquet rows; the last row of an id counts."""

    SCHEMA = "id string, url string, created_at timestamp, status string, version bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def _append(self, id_: str, url: str | None, status: str) -> None:
        # no two writers read and then write the same number: it is the time, and by chance apart within one microsecond
        version = time.time_ns() // 1000 * 1000 + secrets.randbelow(1000)
        row = self.spark.createDataFrame([(id_, url, status, version)], "id string, url string, status string, version bigint")
        row.select("id", "url", F.current_timestamp().alias("created_at"), "status", "version").write.mode("append").parquet(self.path)

    def add(self, id_: str, url: str) -> None:
        if not url.startswith("https://"):
            raise ValueError("an address must begin with https://")
        self._append(id_, url, "active")

    def remove(self, id_: str) -> None:
        self._append(id_, None, "removed")

    def list(self) -> DataFrame:
        return latest_events(self._log(), "id").where("status <> 'removed'").drop("version").orderBy("created_at", "id")

    def get(self, id_: str) -> DataFrame:
        return self.list().where(F.col("id") == id_)


def list_comparisons(log: DataFrame) -> DataFrame:
    """Canary comparisons in the order of their ids."""
    return log.orderBy("event_id")
