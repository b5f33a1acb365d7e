"""Keyed state over streams: expiry by timers, and job states that events may reach in any order.

Both use one small state for each key and event-time timers, so that state goes when it can't matter any more. Events may
come in any order and again and again, as late as the watermark allows; what either stream has said of a key last is
what the batch functions in `live` say of all its events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallgrass.streaming.live import FINISHED, TRANSITIONS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRED = "repository_id string, event_id long, last_updated timestamp, expired boolean"
JOBS = "job_id string, status string, seq long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Queries started from now on keep their state in RocksDB, which timers and several states a key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Expiry(StatefulProcessor):
    """The last state of each key, until it has been finished for so many seconds."""

    def __init__(self, seconds: int, late_ms: int):
        self.seconds, self.late_ms = seconds, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us long, event_id long, status string, told boolean")

    def due(self, at_us: int) -> int:
        """The watermark at which the stream's time is so many whole seconds past this one."""
        return (at_us // 1_000_000 + self.seconds + 1) * 1000 - self.late_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        was = self.last.get() if self.last.exists() else None
        best = (was[0], was[1], was[2]) if was else None
        for f in rows:
            for at, event_id, status in zip(f["at_us"].tolist(), f["event_id"].tolist(), f["status"].tolist(), strict=True):
                if best is None or (at, event_id) > best[:2]:
                    best = (at, event_id, status)
        if was and best == (was[0], was[1], was[2]):
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((*best, False))
        if best[2] in FINISHED:
            self.handle.registerTimer(max(self.due(best[0]), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._told(key, best, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            best = self.last.get()
            self.last.clear()  # what is older is late by now, what is newer begins anew
            yield self._told(key, best, True)

    @staticmethod
    def _told(key: Any, best: tuple, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"repository_id": [key[0]], "event_id": [best[1]], "last_updated": [pd.Timestamp(best[0], unit="us")], "expired": [expired]})

    def close(self) -> None:
        pass


def expiry_stream(events: DataFrame, seconds: int, late_seconds: int = 0) -> DataFrame:
    """A stream of (repository_id, event_id, last_updated, expired) over (repository_id, event_id, last_updated, status): a row when a key's last state changes, and one when it expires.

    Events may be late by late_seconds, which is at most the time to expiry: so when a state expires, all that is older is late.
    """
    if late_seconds > seconds:
        raise ValueError("events may not be later than states live")
    with_state_store(events.sparkSession)
    rows = events.select(F.col("repository_id").cast("string").alias("repository_id"), F.col("event_id").cast("long").alias("event_id"), "status", F.unix_micros(F.col("last_updated").cast("timestamp")).alias("at_us"), F.col("last_updated").cast("timestamp").alias("at"))
    keyed = rows.withWatermark("at", f"{late_seconds} seconds").groupBy("repository_id")
    return keyed.transformWithStateInPandas(Expiry(seconds, 1000 * late_seconds), EXPIRED, "Update", "EventTime")


class Jobs(StatefulProcessor):
    """A job's state: events up to the watermark are folded into one status, later ones are kept in a list and folded on top by seq.

    Each call of a state goes to Spark and back, so a job's events are read and added all at once, whatever their number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "status string, seq long")
        self.open = handle.getListState("events", "seq long, status string, at_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, first, fresh = self._open(), None, {}
        for f in rows:
            for seq, status, at in zip(f["seq"].tolist(), f["status"].tolist(), f["at_ms"].tolist(), strict=True):
                fresh[seq, status] = at
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + 1)
        if added := [(*k, at) for k, at in fresh.items() if known.get(k) != at]:
            self.open.appendList(added)
        now = self._fold(self._base(), sorted(known | fresh))
        if now[0] is not None:
            yield pd.DataFrame({"job_id": [key[0]], "status": [now[0]], "seq": [now[1]]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """What the watermark has passed can't get company any more: the events up to the first that it hasn't."""
        mark, done, kept, rest = timerValues.getCurrentWatermarkInMs(), [], [], None
        for (seq, status), at in sorted(self._open().items()):
            if at > mark:
                rest = at if rest is None else min(rest, at)
            if rest is None:
                done.append((seq, status))
            else:
                kept.append((seq, status, at))
        self.base.update(self._fold(self._base(), done))
        if kept:
            self.open.put(kept)
        else:
            self.open.clear()
        if rest is not None:
            self.handle.registerTimer(rest + 1)
        return iter(())

    def _open(self) -> dict[tuple, int]:
        """Events that are kept: when each was; of one that came again, what came last."""
        return {(seq, status): at for seq, status, at in self.open.get()} if self.open.exists() else {}

    def _base(self) -> tuple:
        return tuple(self.base.get()) if self.base.exists() else (None, None)

    @staticmethod
    def _fold(now: tuple, events: list[tuple]) -> tuple:
        status, at = now
        for seq, wanted in events:
            if status is None and wanted == "pending" or wanted in TRANSITIONS.get(status, ()):
                status, at = wanted, seq
        return status, at

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (job_id, status, seq) over (job_id, seq, status, at): a row when events of a job have come. seq goes up with `at`."""
    with_state_store(events.sparkSession)
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("seq").cast("long").alias("seq"), "status", F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms"), F.col("at").cast("timestamp").alias("at"))
    return rows.withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(Jobs(), JOBS, "Update", "EventTime")


def last_said(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is; its last row for each key (the first column). Each batch is written once by its number, and again if it is run again."""
    spark, key = stream.sparkSession, stream.columns[0]
    save = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")
    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", True).parquet(out)
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in rest])
