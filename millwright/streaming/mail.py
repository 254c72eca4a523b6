"""Streams of mails and events: ingest, deduplication, suggestions, notification states, windows.

Each stream reads a folder of files, remembers in its checkpoint what it has read, and ends once it has read all that is
there (`availableNow`); run again, by a scheduler or with `every`, it reads what is new. Sinks are folders of Parquet
files below the shared folder. Batches that run twice after a failure write the same folder twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of how late a message may be and still be known for a copy.
LATENESS = "1 hour"
RANKS = {"NewEmail": 1, "RelatedEmail": 2}
#: State of a mail of which nothing came for as long as it was kept, and how long that is.
EXPIRED, IDLE_MS = "Expired", 7 * 24 * 3600 * 1000
#: The state store that processors with timers need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None] | None = None, mode: str = "append", every: str | None = None) -> None:
    """Runs a stream into `path`/out, by `write` (batch, number) or as Parquet; `every` is the interval of a lasting one."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    w = w.foreachBatch(write) if write else w.format("parquet").option("path", f"{path}/out")
    w.start().awaitTermination()


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a folder for each batch, again if the batch runs again."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")


def deduplicated(mails: DataFrame, key: str = "message_id", time: str = "received") -> DataFrame:
    """The first of all mails with one id, as far as they come within the lateness; the state of older ones is dropped."""
    return mails.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark([key])


def windows(events: DataFrame, width: str, slide: str | None = None, time: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts by key and window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, LATENESS).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's events without a gap of that length, once no later event can join them."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, LATENESS).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def notification_states(events: DataFrame) -> DataFrame:
    """events (email_key, notification_type) -> the state of a mail whenever it is created or promoted; repeats change nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        best = old
        for frame in frames:
            for kind in frame["notification_type"].dropna().unique():
                if best is None or (RANKS.get(kind, 0), kind) > (RANKS.get(best, 0), best):
                    best = kind
        if best != old:
            state.update((best,))
            yield pd.DataFrame({"email_key": [key[0]], "state": [best]})

    rows = events.select("email_key", "notification_type").groupBy("email_key")
    return rows.applyInPandasWithState(step, "email_key long, state string", "state string", "update", GroupStateTimeout.NoTimeout)


class _Notifications(StatefulProcessor):
    """The state of one mail; a timer in event time ends it when nothing comes for `idle_ms`, so what is kept is bounded by the mails of that time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "kind string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.state.get() if self.state.exists() else None
        best, last = old or (None, -(1 << 62))
        for frame in rows:
            last = max(last, int(frame["ms"].max()))
            for kind in frame["notification_type"].dropna().unique():
                if best is None or (RANKS.get(kind, 0), kind) > (RANKS.get(best, 0), best):
                    best = kind
        if old is not None:
            self.handle.deleteTimer(old[1] + self.idle_ms)
        self.state.update((best, last))
        self.handle.registerTimer(last + self.idle_ms)
        if old is None or best != old[0]:
            yield pd.DataFrame({"email_key": [key[0]], "state": [best], "last": [last]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[1]
        self.state.clear()
        yield pd.DataFrame({"email_key": [key[0]], "state": [EXPIRED], "last": [last]})

    def close(self) -> None:
        pass


def expiring_states(events: DataFrame, idle_ms: int = IDLE_MS, time: str = "ts") -> DataFrame:
    """events (email_key, notification_type, time) -> email_key, state and last (of its events, in milliseconds) whenever a mail is created or
    promoted, and EXPIRED when event time has passed its last event by `idle_ms`. A mail that comes again after that is new. Run it within rocks()."""
    rows = events.withWatermark(time, LATENESS).where(F.col("email_key").isNotNull()).select("email_key", "notification_type", time, F.unix_millis(time).alias("ms"))
    return rows.groupBy("email_key").transformWithStateInPandas(_Notifications(idle_ms), "email_key long, state string, last long", "update", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store for processors with timers, for the streams that are started within; the session's own comes back after that."""
    old = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(ROCKS[0]) if old is None else spark.conf.set(ROCKS[0], old)
