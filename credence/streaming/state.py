"""Feeds with state of their own: the last arrivals, and verdicts per minute counted back from now.

Both need the RocksDB state store: start them inside ``state_store``. Keys are spread over shards, so that no task sees the whole
feed; a reader adds up or merges what the shards hold, which is of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LAST = 300              # arrivals that a feed shows
SHARDS = 16
BUCKETS = 15
KEEP = "7 days"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside the block keep their state in RocksDB; others keep what the session has."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


# ----------------------------------------------------------------------------- last arrivals

class LastArrivals(StatefulProcessor):
    """A ring of the ``n`` rows of a shard that arrived last, by their arrival number."""

    def __init__(self, schema: T.StructType, arrival: str, n: int, keep: str | None) -> None:
        self.schema, self.arrival, self.n = schema, arrival, n
        self.ttl = None if keep is None else _millis(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        self.ring = handle.getMapState("ring", "slot int", ddl, self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.ring.iterator()}
        at = self.schema.names.index(self.arrival)
        newest = sorted((v for v in held.values()), key=lambda v: v[at])
        for part in rows:       # at most 2 n rows at a time, however many came
            part = part.nlargest(self.n, self.arrival)[self.schema.names].astype(object)
            part = part.where(part.notna(), None)
            newest = sorted([*newest, *part.itertuples(index=False, name=None)], key=lambda v: v[at])[-self.n:]
        places = {v[at]: slot for slot, v in held.items()}
        kept = {v[at] for v in newest}
        free = [slot for slot in range(self.n) if slot not in held or held[slot][at] not in kept]
        for v in newest:        # only slots whose row changes are written
            if v[at] not in places:
                self.ring.updateValue((free.pop(0),), v)
        out = pd.DataFrame(newest, columns=self.schema.names)
        out.insert(0, "shard", key[0])
        yield out

    def close(self) -> None:
        pass


def last_arrivals(feed: DataFrame, arrival: str, n: int = LAST, shards: int = SHARDS, key: str = "id", keep: str | None = None) -> DataFrame:
    """A stream of snapshots: whenever a shard gets rows, the ``n`` of its rows with the greatest arrival numbers.

    Arrival numbers are unique longs that grow in the order of arrival, such as offsets; event times play no part.
    ``keep`` lets a shard forget rows after that time (the query then runs in processing time and is not for ``availableNow``).
    """
    schema = feed.schema
    out = T.StructType([T.StructField("shard", T.LongType()), *schema.fields])
    sharded = feed.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return sharded.groupBy("shard").transformWithStateInPandas(
        LastArrivals(schema, arrival, n, keep), out, "Update", "None" if keep is None else "ProcessingTime")


def write_last_arrivals(snapshots: DataFrame, path: str, checkpoint: str, until_idle: bool = False, interval: str = "5 seconds") -> StreamingQuery:
    """Keeps the newest snapshot of every shard below ``path``; a repeated batch replaces its folders by the same rows."""
    def replace(batch: DataFrame, number: int) -> None:
        (batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
    trigger = {"availableNow": True} if until_idle else {"processingTime": interval}
    with state_store(snapshots.sparkSession):
        return (snapshots.writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint)
                .trigger(**trigger).queryName("last-arrivals").start())


def read_last_arrivals(spark: SparkSession, path: str, arrival: str, n: int = LAST) -> DataFrame:
    """The ``n`` rows that arrived last, newest first: of ``n`` rows per shard."""
    return spark.read.parquet(path).drop("shard").orderBy(F.desc(arrival)).limit(n)


# ----------------------------------------------------------------------------- verdicts per minute, back from now

class MinuteCounts(StatefulProcessor):
    """Rows per minute of a shard. At the end of every minute a timer emits all buckets back from there, empty ones
    with 0, also when nothing new has come; it stops once all are empty."""

    def __init__(self, time: str, buckets: int, seconds: int) -> None:
        self.time, self.buckets, self.width = time, buckets, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "bucket long", "n long")
        self.next = handle.getValueState("next", "at long")

    def _set(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            bucket = part[self.time].astype("datetime64[ms]").astype("int64") // self.width
            for b, n in bucket.value_counts().items():
                old = self.counts.getValue((int(b),)) if self.counts.containsKey((int(b),)) else None
                self.counts.updateValue((int(b),), ((old[0] if old else 0) + int(n),))
                first = b if first is None else min(first, b)
        now = max(timerValues.getCurrentWatermarkInMs(), 0) if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        due = max((int(first) + 1) * self.width, (now // self.width + 1) * self.width)
        if not self.next.exists():
            self._set(due)
        elif due < (at := self.next.get()[0]):
            self.handle.deleteTimer(at)
            self._set(due)
        return iter(())

    event_time = True

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        while True:         # also the minutes that have ended since, should the timer be late
            end = at // self.width
            yield pd.DataFrame({"shard": key[0], "now": pd.Timestamp(at, unit="ms"), "bucket": range(self.buckets),
                                "n": [held.get(end - self.buckets + i, 0) for i in range(self.buckets)]})
            for b in [b for b in held if b < end - self.buckets + 1]:
                del held[b]
                self.counts.removeKey((b,))
            if not held:
                self.next.clear()
                return
            at = max(at, min(held) * self.width) + self.width       # nothing is shown before the first minute that has rows
            if at > now:
                self._set(at)
                return

    def close(self) -> None:
        pass


class LiveMinuteCounts(MinuteCounts):
    event_time = False


COUNTS = "shard long, now timestamp, bucket int, n long"


def minute_counts(feed: DataFrame, time: str = "scored_at", buckets: int = BUCKETS, seconds: int = 60, shards: int = SHARDS,
                  key: str = "id", delay: str | None = None) -> DataFrame:
    """(shard, now, bucket, n): at the end of every minute the rows of each of the ``buckets`` minutes before it, the last
    bucket being the newest. Shards add up, see ``total_counts``.

    With ``delay`` now is the event time that the watermark has passed, for feeds that are replayed; without, it is the
    clock, and timers go off while nothing comes.
    """
    sharded = feed.select(F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), F.col(time).cast("timestamp").alias(time))
    if delay is None:
        return sharded.groupBy("shard").transformWithStateInPandas(LiveMinuteCounts(time, buckets, seconds), COUNTS, "Append", "ProcessingTime")
    return sharded.withWatermark(time, delay).groupBy("shard").transformWithStateInPandas(
        MinuteCounts(time, buckets, seconds), COUNTS, "Append", "EventTime")


def total_counts(counts: DataFrame, now: Column | None = None) -> DataFrame:
    """(now, bucket, n) over all shards; a shard that has nothing left says nothing."""
    rows = counts if now is None else counts.where(F.col("now") == now)
    return rows.groupBy("now", "bucket").agg(F.sum("n").alias("n"))
