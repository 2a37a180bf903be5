"""The live path as Structured Streaming: scoring, replies that come late, twice or not at all, rates per client."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weir.functions import features
from weir.operators import policy, validate
from weir.streaming.replies import first_replies

#: How long a reply is waited for, and a canary's.
REPLY_MS, CANARY_S = 50, 60


def scored(requests: DataFrame, model, keep: tuple[str, ...]) -> DataFrame:
    """Requests of a stream with features and the verdict on model(features), an array of probabilities."""
    f = features.extract(requests, keep)
    return f.select(*keep, policy.decide(model(f), F.lit(None).cast("double")).alias("d")).select(*keep, "d.*")


def with_replies(requests: DataFrame, replies: DataFrame, *, wait_ms: int = REPLY_MS, lateness: str = "1 second") -> DataFrame:
    """Each request once, with the probabilities of its first reply in time, else null: the verdict is then timeout.

    `requests` has id and ts, `replies` id, replied_at and probabilities; times
    are timestamps. Further replies, and requests that are read again, change
    nothing; see `first_replies`.
    """
    met = first_replies(requests, replies, event_id="id", at="ts", reply_id="id", replied_at="replied_at", after_ms=wait_ms, lateness=lateness)
    return met.select(*requests.columns, F.col("_reply.probabilities").alias("probabilities"))


def with_canary(events: DataFrame, canary: DataFrame, *, wait_s: int = CANARY_S) -> DataFrame:
    """One comparison of each event that a candidate answered, with its first reply within the time on either side."""
    met = first_replies(events, canary, event_id="event_id", at="ts", reply_id="event_id", replied_at="replied_at", after_ms=1000 * wait_s, before_ms=1000 * wait_s, lateness=f"{wait_s} seconds", eager=True)
    c = policy.decide(F.col("_reply.probabilities"), F.lit(None).cast("double"))
    return met.where("_reply is not null").select("event_id", "verdict", c["verdict"].alias("canary_verdict"), ((F.col("verdict") == "block") == (c["verdict"] == "block")).alias("verdict_match"), F.abs(c["confidence"] - F.col("confidence")).alias("confidence_delta"))


def late_patches(events: DataFrame, replies: DataFrame, *, wait_ms: int = REPLY_MS, lateness: str = "1 second", anomaly_below: float = policy.ANOMALY_BELOW) -> DataFrame:
    """Events with the first anomaly score that comes within the time limit, each event once.

    `events` has event_id, ts, verdict, if_score; `replies` event_id,
    replied_at, late. A score turns pass into pass_anomaly and leaves blocked
    events alone; timed-out events and later replies stay as they are.
    """
    met = first_replies(events, replies.where("late is not null"), event_id="event_id", at="ts", reply_id="event_id", replied_at="replied_at", after_ms=wait_ms, lateness=lateness)
    late = F.col("_reply.late")
    hit = late.isNotNull() & (F.col("verdict") != "timeout")
    anomaly = hit & (late < anomaly_below)
    return met.select(
        "event_id", "ts", F.when(anomaly & (F.col("verdict") == "pass"), "pass_anomaly").otherwise(F.col("verdict")).alias("verdict"),
        F.when(hit, late).otherwise(F.col("if_score")).alias("if_score"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"), hit.alias("patched"),
    )


def ingest(lines: DataFrame, width: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Telemetry from a stream of JSON texts (`value`): its fields, `error` (null for what is accepted) and the columns in `keep`."""
    schema = "vector array<double>, predicted_class string, confidence double, timestamp bigint, source_id string"
    rows = lines.select(*keep, F.from_json("value", schema).alias("r")).select(*keep, "r.*")
    return rows.withColumn("error", validate.telemetry_error(width))


def client_rates(lines: DataFrame, *, seconds: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """Each line with the number of lines, the share of 4xx and the number of paths of its client in the seconds before it.

    `lines` has client_ip, ts, path, status_code. State holds one window of a
    client and goes when its watermark has passed. Counts are differences of
    running sums at places found by binary search; a path counts where its last
    occurrence lies in the window.
    """
    schema = "client_ip string, ts timestamp, path string, status_code int, req_count bigint, error_rate_4xx double, endpoint_diversity bigint"
    us = seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, paths, codes = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        now = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        t = np.concatenate((np.array(times, np.int64), now))
        path, code = np.array(paths + rows["path"].tolist(), object), np.array(codes + rows["status_code"].tolist(), np.int64)
        order = np.argsort(t, kind="stable")
        t, path, code = t[order], path[order], code[order]
        low, high = np.searchsorted(t, now - us), np.searchsorted(t, now)
        bad = np.append(0, np.cumsum(code // 100 == 4))
        count, errors = high - low, bad[high] - bad[low]
        frame = pd.DataFrame({
            "client_ip": key[0], "ts": rows["ts"], "path": rows["path"], "status_code": rows["status_code"].astype("int32"), "req_count": count,
            "error_rate_4xx": np.where(count > 0, errors / np.maximum(count, 1), 0.0), "endpoint_diversity": distinct_in(path, low, high),
        })
        kept = t >= t.max() - us
        state.update((t[kept].tolist(), path[kept].tolist(), code[kept].tolist()))
        state.setTimeoutTimestamp(int(t.max()) // 1000 + seconds * 1000 + 1)
        yield frame

    known = lines.select("client_ip", F.col("ts").cast("timestamp").alias("ts"), "path", F.col("status_code").cast("int").alias("status_code")).withWatermark("ts", lateness)
    return known.groupBy("client_ip").applyInPandasWithState(step, schema, "times array<bigint>, paths array<string>, codes array<int>", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The number of distinct values in each window [low, high) of windows whose ends do not fall: two pointers, one step a value."""
    out, seen, a, b = np.zeros(len(low), np.int64), {}, 0, 0
    for k, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        while b < y:
            seen[values[b]] = seen.get(values[b], 0) + 1
            b += 1
        while a < x:
            if seen[values[a]] == 1:
                del seen[values[a]]
            else:
                seen[values[a]] -= 1
            a += 1
        out[k] = len(seen)
    return out


def run_for(query, seconds: float) -> bool:
    """Lets a query run for a bounded time, then stops it; whether it ended by itself."""
    ended = query.awaitTermination(seconds)
    query.stop()
    return bool(ended)


def drain(query) -> None:
    """Waits until all that a source has is processed, then stops."""
    query.processAllAvailable()
    query.stop()
