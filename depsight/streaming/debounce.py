"""Change events of files, coalesced: of a burst of events on a path only the last decision counts, once the path is quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def classified(kind: Column) -> Column:
    """touched or removed for a raw event kind; null for those that don't matter. Renames of any kind count as removals."""
    touched = kind.isin("any", "create", "modify_any", "modify_data", "modify_metadata")
    return F.when(touched, "touched").when(kind.startswith("rename") | kind.isin("remove_file", "remove_any"), "removed")


def sessions(events: DataFrame, quiet: str = "500 milliseconds", late: str | None = None) -> DataFrame:
    """path, ripe, events, kind for each burst of (path, kind, ts) events with gaps below quiet; works on tables and, with late, on streams."""
    source = events.withWatermark("ts", late) if late else events
    found = source.groupBy(F.session_window("ts", quiet).alias("burst"), "path").agg(F.count("*").alias("events"), F.max_by("kind", "ts").alias("kind"))
    return found.select("path", F.col("burst.end").alias("ripe"), "events", "kind")


BURST = "kind string, events long, timer long"


class Burst(StatefulProcessor):
    """The pending burst of one path: its last decision, its number of events, and the timer that ends it."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pending = handle, handle.getValueState("pending", BURST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, events, last = None, 0, None
        for b in rows:
            events += len(b)
            k = b["ts"].argmax()
            if last is None or b["ts"].iloc[k] >= last:
                kind, last = b["kind"].iloc[k], b["ts"].iloc[k]
        if self.pending.exists():
            _, before, timer = self.pending.get()
            events += before
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(timer)
        self.pending.update((kind, events, timer))
        yield from ()  # bursts come out by their timers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.pending.exists():
            kind, events, _ = self.pending.get()
            self.pending.clear()
            yield pd.DataFrame({"path": pd.Series([key[0]], dtype=object), "kind": pd.Series([kind], dtype=object), "events": [events]})

    def close(self) -> None:
        pass


def arrivals(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """path, kind, events for each burst of a stream of (path, kind, ts): the last decision of a path on which nothing has come in for quiet_ms.

    The clock is that of arrival: each event puts its path's timer off, and a timer that runs out emits the burst, whether or not other events come. Of events
    that come in at once the latest by ts decides. What is pending is state with the stream's checkpoint; the session's state store has to be RocksDB.
    """
    keyed = events.select("path", "kind", "ts").groupBy("path")
    return keyed.transformWithStateInPandas(statefulProcessor=Burst(quiet_ms), outputStructType="path string, kind string, events long", outputMode="append", timeMode="processingTime")


def pending(spark: SparkSession, checkpoint: str) -> DataFrame:
    """path, kind, events of the bursts that a stopped stream of arrivals() still held: the forced flush, so that the last burst isn't lost with the stream.

    They stay in the state: a stream that is started again on the checkpoint emits them, too, and a decision that is applied twice changes nothing.
    """
    held = spark.read.format("statestore").option("stateVarName", "pending").load(checkpoint)
    return held.select(F.col("key.path").alias("path"), F.col("value.kind").alias("kind"), F.col("value.events").alias("events"))
