"""A stream of file events that keeps an index current: classified, gated, coalesced, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depsight.functions import paths as P
from depsight.plans.kept import KeptIndex
from depsight.sources import tree
from depsight.streaming.debounce import arrivals, classified
from depsight.tables import dropped, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def forwarded(events: DataFrame) -> DataFrame:
    """path, kind (touched, removed), ts of the raw events (path, kind, ts) that matter: source files outside of node_modules and hidden folders."""
    seen = events.withColumn("kind", classified(F.col("kind")))
    return seen.where(F.col("kind").isNotNull() & P.is_source(F.col("path")) & ~F.col("path").rlike(r"(^|/)(node_modules|\.[^/]*)(/|$)"))


def applied(batch: DataFrame, path: str, read: Callable[[DataFrame], DataFrame], rules: Callable[[], DataFrame] | None = None, number: int | None = None) -> tuple[KeptIndex, DataFrame | None]:
    """The kept index in a folder after the last decisions (path, kind) of a batch, and what they changed; no diff where nothing counts or the batch is known.

    read: path and content of the paths asked for, those that are there. rules: the ignore rules as they stand (tree.rules_of()); ignored files don't count.
    """
    old = KeptIndex.open(batch.sparkSession, path)
    last = written(batch.select("path", "kind").distinct(), "events")
    if rules is not None:
        last = last.join(tree.ignored(last, rules()), "path", "left_anti")
    there = read(last.where("kind = 'touched'").select("path")).select("path", "content")
    changes = last.select("path").join(there.withColumn("found", F.lit(True)), "path", "left").select("path", "content", F.col("found").isNull().alias("removed"))
    changes = written(changes, "changes")
    out = (old, None) if changes.isEmpty() else old.apply(changes, number)
    dropped(last)
    return out


def follow(
    events: DataFrame, path: str, read: Callable[[DataFrame], DataFrame], checkpoint: str, seen: Callable[[KeptIndex, DataFrame], None], quiet_ms: int = 500, rules: Callable[[], DataFrame] | None = None, every: str = "200 milliseconds",
) -> StreamingQuery:
    """Starts a query that goes on until it is stopped: what the last decisions about files change in the kept index in a folder; seen gets index and diff.

    events: a stream of raw (path, kind, ts). The index is in its folder and knows the last batch that it holds, so that a query that is started again on its
    checkpoint goes on where it ended: a batch that was applied isn't applied again. After a stop, applied(pending(...)) flushes what was still in a burst.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        new, diff = applied(batch, path, read, rules, number)
        if diff is not None:
            seen(new, diff)

    return arrivals(forwarded(events), quiet_ms).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
