"""Change streams: events debounced to the last of each path and merged into an index, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window as W

from ..operators.index import Store
from ..sources.ingest import EXCLUDE, INCLUDE, should_include

EVENTS = "path string, type string, seq long"
CHANGED, DELETED = "CREATE_OR_MODIFY", "DELETE"


def last_wins(events: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last event of each key."""
    return events.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def wanted(events: DataFrame, include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    """Patterns hold for changes, not for deletions."""
    return events.where((F.col("type") == DELETED) | should_include(F.col("path"), include, exclude))


def apply_batch(store: Store, events: DataFrame, load: Callable[[DataFrame], DataFrame], include=INCLUDE, exclude=EXCLUDE) -> dict:
    """One batch: the last event of each path; contents of changed paths by `load` (paths -> documents); empty or gone ones are deleted."""
    last = last_wins(wanted(events, include, exclude)).persist()
    changed = last.where(F.col("type") == CHANGED).select(F.col("path").alias("doc_id"))
    docs = load(changed).persist()
    try:
        full = docs.where("length(trim(text)) > 0")
        gone = last.where(F.col("type") == DELETED).select(F.col("path").alias("doc_id")).union(changed.join(full.select("doc_id"), "doc_id", "left_anti"))
        n, m = full.count(), gone.count()
        if n or m and store.version():  # one commit: no reader sees the deletions without the changes
            store.apply(full if n else None, gone if m else None, note="batch")
        return {"upserted": n, "deleted": m}
    finally:
        last.unpersist()
        docs.unpersist()


def watch(spark: SparkSession, folder: str, store: Store, load: Callable[[DataFrame], DataFrame], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Follows a folder of event files (JSON lines of EVENTS): a micro-batch is a debounce interval, and applies as one change.

    Without an interval it takes what there is and stops. A batch that runs again after a failure ends in the same index.
    """
    events = spark.readStream.schema(EVENTS).json(folder)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(store, df, load) and None)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def listing_events(spark: SparkSession, before: DataFrame, now: DataFrame) -> DataFrame:
    """Events between two listings (path, modified): a file source does not tell of deletions, a comparison of listings does."""
    a, b = before.select("path", F.col("modified").alias("a")), now.select("path", F.col("modified").alias("b"))
    d = a.join(b, "path", "full_outer").where("NOT (a <=> b)")
    return d.select("path", F.when(F.col("b").isNull(), DELETED).otherwise(CHANGED).alias("type"), F.coalesce("b", "a").cast("long").alias("seq"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Events per window and kind with a watermark; works on streams and on tables."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


class Crawler:
    """States of a crawler: IDLE, CRAWLING, PAUSED, WATCHING."""

    def __init__(self):
        self.state, self.query = "IDLE", None

    def start(self, query: StreamingQuery) -> None:
        if self.state not in ("IDLE", "PAUSED"):
            raise RuntimeError(f"Cannot start a crawler that is {self.state}")
        self.state, self.query = "WATCHING", query

    def pause(self) -> None:
        if self.query is None:
            raise RuntimeError("Nothing runs")
        self.query.stop()
        self.state = "PAUSED"

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.state, self.query = "IDLE", None
