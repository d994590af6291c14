"""Keyed state with timers, collections and time to live, and an account of rows that came too late.

The processors run on the RocksDB state store, whose state may outgrow memory and is restored from the checkpoint on other executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Spark hands rows of null keys to other keys' processors, so a null user is keyed by a flag.
USER = ("coalesce(user_id, 0L) AS user_id", "user_id IS NULL AS none")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def user():
    return F.expr("if(none, null, user_id)").alias("user_id")


def micros(interval: str) -> int:
    """An interval of whole units, such as '6 hours', in microseconds."""
    return round(pd.Timedelta(interval).total_seconds() * 1e6)


class SelfClosingSessions(StatefulProcessor):
    """Open sessions of a key as a map from begin to (end, events).  Rows merge whatever sessions they touch, in any order; each session
    sets a timer for its end and is handed on when the watermark has passed that."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "begins long", "ends long, n long")

    def timer(self, ends: int) -> int:
        return -(-ends // 1000)  # timers are milliseconds; a session is over at the next whole one

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {begins: value for (begins,), value in self.open.iterator()}
        spans = [(begins, ends, n) for begins, (ends, n) in before.items()]
        for frame in rows:
            at = frame["at"].dropna().astype("int64")
            spans += [(t, t + self.gap, n) for t, n in at.value_counts().items()]
        merged: list[list[int]] = []
        for begins, ends, n in sorted(spans):
            if merged and begins < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], ends)
                merged[-1][2] += n
            else:
                merged.append([begins, ends, n])
        after = {int(begins): (int(ends), int(n)) for begins, ends, n in merged}
        timers = {self.timer(ends) for ends, _ in after.values()}
        for begins, (ends, n) in before.items():
            if after.get(begins) != (ends, n):
                self.open.removeKey((begins,))
                if self.timer(ends) not in timers:
                    self.handle.deleteTimer(self.timer(ends))
        for begins, value in after.items():
            if before.get(begins) != value:
                self.open.updateValue((begins,), value)
                self.handle.registerTimer(self.timer(value[0]))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(begins, ends, n) for (begins,), (ends, n) in self.open.iterator() if self.timer(ends) <= now]
        for begins, _, _ in over:
            self.open.removeKey((begins,))
        if over:
            yield pd.DataFrame([(*key, *o) for o in sorted(over)], columns=["user_id", "none", "begins", "ends", "n"])

    def close(self) -> None:
        pass


def closing_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, begins, ends, n of a stream of events, once for each session, when it is over; the batch twin is user_sessions().

    Rows without a time are in no session; null users are a user; rows behind the watermark are dropped (see late_rows)."""
    rows = events.withWatermark("ts", late).selectExpr(*USER, "ts", "unix_micros(ts) AS at")
    out = rows.groupBy("user_id", "none").transformWithStateInPandas(
        SelfClosingSessions(micros(gap)), "user_id long, none boolean, begins long, ends long, n long", outputMode="Append", timeMode="EventTime"
    )
    return out.select(user(), F.timestamp_micros("begins").alias("begins"), F.timestamp_micros("ends").alias("ends"), "n")


class FirstWithin(StatefulProcessor):
    """Ids seen of a key, as a map whose entries live for a while after they were written."""

    def __init__(self, live_ms: int, column: str):
        self.live_ms, self.column = live_ms, column

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id long", "times long", self.live_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            first = frame.drop_duplicates(self.column)
            new = [pd.isna(i) or not self.seen.containsKey((int(i),)) for i in first[self.column]]
            for i in first[self.column][new].dropna():
                self.seen.updateValue((int(i),), (1,))
            if any(new):
                yield first[new]

    def close(self) -> None:
        pass


def first_within(events: DataFrame, live: str = "1 hour") -> DataFrame:
    """Events whose id the same user has not sent before, as far as ids are remembered: for `live` of the clock after they were first seen.
    A watermark is not needed, so late events are kept.  Null ids are not remembered.  Spark runs batches without data for state on
    the clock, without end: where a query shall end by itself, spark.sql.streaming.noDataMicroBatches.enabled must be false."""
    rows = events.selectExpr(*USER, *[f"`{c}`" for c in events.columns if c != "user_id"])
    out = rows.groupBy("user_id", "none").transformWithStateInPandas(
        FirstWithin(micros(live) // 1000, "event_id"), rows.schema, outputMode="Append", timeMode="ProcessingTime"
    )
    return out.withColumn("user_id", user()).select(*events.columns)


def late_rows(query: StreamingQuery) -> list[dict]:
    """For each batch that Spark still tells of: batch, rows read, rows that stateful operators dropped behind the watermark, and the
    watermark then.  An operator counts what reaches it: rows for one that keeps each, partial groups for an aggregation."""
    out = []
    for p in query.recentProgress:
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        out.append({"batch": p.batchId, "rows": p.numInputRows, "dropped": dropped, "watermark": (p.eventTime or {}).get("watermark")})
    return out
