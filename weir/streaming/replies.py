"""First replies: each event once, with the first reply that came in time, by keyed state and timers.

Events and replies are one stream keyed by the event's id. An event waits until
the watermark has passed the end of its time; only then is it known which reply
was the first, however late and in whatever order they were read. It is emitted
once, by its timer. Later replies, replies of a second answer and events that are
read again meet a marker and are passed over. State is bounded by the watermark:
events go when they are emitted, replies without an event when none can follow,
markers some time later.

The same on batch frames is one aggregation. Streams need the RocksDB state store
(`state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "key string, event string, reply string"


def state_store(spark: SparkSession) -> None:
    """The state store that keyed state with timers needs, for queries that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class FirstReply(StatefulProcessor):
    """States of a key: waiting for its event, waiting for the end of its time, done."""

    def __init__(self, before_us: int, after_us: int, keep_us: int, eager: bool):
        self.before, self.after, self.keep, self.eager = before_us, after_us, keep_us, eager

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "at bigint, body string")
        self.replies = handle.getListState("replies", "at bigint, body string")
        self.done = handle.getValueState("done", "until bigint")

    def _timer(self, us: int) -> int:
        """The first whole millisecond after a time."""
        ms = us // 1000 + 1
        self.handle.registerTimer(ms)
        return ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = [r for frame in rows for r in frame.itertuples(index=False)]
        if self.done.exists():
            return
        for r in sorted(arrived, key=lambda r: -r.kind):
            if r.kind == 1:
                if not self.event.exists():
                    self.event.update((int(r.us), r.body))
                    self._timer(int(r.us) + self.after)
            else:
                self.replies.appendValue((int(r.us), r.body))
                if not self.event.exists():
                    self._timer(int(r.us) + self.before)
        if self.event.exists():
            first = self._first()
            self.replies.clear()
            if first is not None and self.eager:
                yield self._out(key, first)
            elif first is not None:
                self.replies.appendValue(first)

    def _out(self, key, first) -> pd.DataFrame:
        at, body = self.event.get()
        self.event.clear()
        self.replies.clear()
        self.done.update((self._timer(at + self.after + self.keep),))
        return pd.DataFrame({"key": [key[0]], "event": [body], "reply": [first[1] if first else None]})

    def _first(self):
        at = self.event.get()[0]
        timely = [(int(r[0]), r[1]) for r in self.replies.get() if at - self.before <= r[0] <= at + self.after] if self.replies.exists() else []
        return min(timely, default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.event.exists():
            if now >= (self.event.get()[0] + self.after) // 1000 + 1:
                yield self._out(key, self._first())
        elif self.done.exists():
            if now >= self.done.get()[0]:
                self.done.clear()
        elif self.replies.exists():
            left = [(int(r[0]), r[1]) for r in self.replies.get() if (r[0] + self.before) // 1000 + 1 > now]
            self.replies.clear()
            for r in left:
                self.replies.appendValue(r)


def first_replies(events: DataFrame, replies: DataFrame, *, event_id: str, at: str, reply_id: str, replied_at: str, after_ms: int, before_ms: int = 0, lateness: str = "1 second", keep_ms: int = 600_000, eager: bool = False) -> DataFrame:
    """The events' columns and `_reply`, a struct of the replies' columns: the first by time that lies between `before_ms` before and `after_ms` after the event, else null.

    Each event once. Events without an id or time, and replies without, take no
    part; of events that share an id the first counts (in a batch that of the
    least time, in a stream that which is read first); of replies of one time the
    least by its JSON. In a stream an event comes out when the watermark has
    passed its time; `keep_ms` is how long one that is read again is recognised.
    An `eager` stream does not wait for replies of an earlier time: the first is
    that which is read first, of those read together the first by time.
    """
    spark = events.sparkSession
    e = events.where(F.col(event_id).isNotNull() & F.col(at).isNotNull())
    r = replies.where(F.col(reply_id).isNotNull() & F.col(replied_at).isNotNull())
    body = F.to_json(F.struct("*"), _EXACT).alias("body")
    key = lambda c: F.col(c).cast("string").alias("key")
    us = lambda c: F.unix_micros(F.col(c)).alias("us")
    if events.isStreaming or replies.isStreaming:
        state_store(spark)
        a = e.withWatermark(at, lateness).select(key(event_id), F.col(at).alias("time"), us(at), F.lit(1).alias("kind"), body)
        b = r.withWatermark(replied_at, lateness).select(key(reply_id), F.col(replied_at).alias("time"), us(replied_at), F.lit(0).alias("kind"), body)
        machine = FirstReply(before_ms * 1000, after_ms * 1000, keep_ms * 1000, eager)
        met = a.unionByName(b).groupBy("key").transformWithStateInPandas(machine, _OUT, "Append", "EventTime")
    else:
        first = e.select(key(event_id), us(at), body).groupBy("key").agg(F.min(F.struct("us", "body")).alias("e"))
        near = F.col("us").between(F.col("e.us") - before_ms * 1000, F.col("e.us") + after_ms * 1000)
        answers = first.join(r.select(key(reply_id), us(replied_at), body), "key").where(near).groupBy("key").agg(F.min(F.struct("us", "body")).alias("r"))
        met = first.join(answers, "key", "left").select("key", F.col("e.body").alias("event"), F.col("r.body").alias("reply"))
    return met.select(F.from_json("event", e.schema, _EXACT).alias("_event"), F.from_json("reply", r.schema, _EXACT).alias("_reply")).select("_event.*", "_reply")
