"""Streams with state: last arrivals and counts per minute."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from credence.streaming import state

FEED = "id string, scored_at timestamp, label string, arrival long"


def rows(n, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    out = [(f"i{i % 90}", start + timedelta(seconds=rng.randint(0, 5000)), rng.choice(["a", None]), i) for i in range(n)]
    rng.shuffle(out)
    return out


def stream_of(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("n, shards, total", [(20, 3, 500), (50, 1, 30), (5, 8, 200)])
def test_last_arrivals_out_of_order(spark, tmp_path, n, shards, total):
    """Batches hold arrival numbers in any order: late numbers of an early batch stay."""
    found = rows(total)
    parts = [found[i::3] for i in range(3)]
    stream = stream_of(spark, f"{tmp_path}/in", parts)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.write_last_arrivals(state.last_arrivals(stream, "arrival", n, shards), f"{tmp_path}/out", f"{tmp_path}/check", until_idle=True).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = [tuple(r) for r in state.read_last_arrivals(spark, f"{tmp_path}/out", "arrival", n).collect()]
    assert got == sorted(found, key=lambda r: -r[3])[:n]


def test_last_arrivals_after_a_restart(spark, tmp_path):
    found = rows(120, 2)
    for part in (found[:60], found[60:]):
        stream = stream_of(spark, f"{tmp_path}/in", [part])
        state.write_last_arrivals(state.last_arrivals(stream, "arrival", 10, 2), f"{tmp_path}/out", f"{tmp_path}/check", until_idle=True).awaitTermination()
    got = [r["arrival"] for r in state.read_last_arrivals(spark, f"{tmp_path}/out", "arrival", 10).collect()]
    assert got == list(range(119, 109, -1))


def counts_of(spark, tmp_path, parts, **options):
    stream = stream_of(spark, f"{tmp_path}/in", parts)
    counts = state.minute_counts(stream, **options)
    with state.state_store(spark):
        query = (counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start())
    query.awaitTermination()
    total = state.total_counts(spark.read.schema(state.COUNTS).parquet(f"{tmp_path}/out")).collect()
    out = {}
    for r in total:
        out.setdefault(r["now"], {})[r["bucket"]] = r["n"]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_minutes_of_a_replayed_feed(spark, tmp_path):
    """Three batches with empty minutes between them: every minute that has passed is shown, empty buckets with 0."""
    start = datetime(2024, 1, 1)
    def at(minute, second):
        return (f"i{minute}{second}", start + timedelta(minutes=minute, seconds=second), None, 0)
    parts = [[at(0, 5), at(0, 50), at(1, 1)], [at(4, 2), at(4, 59)], [at(30, 0), at(31, 30)]]
    got = counts_of(spark, tmp_path, parts, buckets=3, shards=2, delay="0 seconds")
    per = {0: 2, 1: 1, 4: 2, 30: 1, 31: 1}
    ends = [e for e in range(1, 32) if any(e - 3 <= m < e for m in per)]
    assert got == {start + timedelta(minutes=e): [per.get(m, 0) for m in range(e - 3, e)] for e in ends}


def test_minutes_by_the_clock_go_on_without_input(spark, tmp_path):
    """One batch, then nothing: timers show the seconds that follow, until all buckets are empty."""
    def now():
        return datetime.fromtimestamp(time.time())
    spark.createDataFrame([("x", now(), None, 0), ("y", now(), None, 1)], FEED).coalesce(1).write.parquet(f"{tmp_path}/in")
    # Scored a little later than written: the rows count by the second in which they were scored.
    stream = spark.readStream.schema(FEED).parquet(f"{tmp_path}/in").withColumn("scored_at", F.current_timestamp())
    counts = state.minute_counts(stream, buckets=3, seconds=2, shards=1)
    with state.state_store(spark):
        query = (counts.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start())
    seen = []
    end = time.time() + 60
    while time.time() < end and len(seen) < 9:
        time.sleep(1)
        try:
            seen = spark.read.schema(state.COUNTS).parquet(f"{tmp_path}/out").orderBy("now", "bucket").collect()
        except Exception:       # nothing is written yet
            continue
    query.stop()
    shown = [[r["n"] for r in seen if r["now"] == t] for t in sorted({r["now"] for r in seen})]
    assert shown[:3] == [[0, 0, 2], [0, 2, 0], [2, 0, 0]]
