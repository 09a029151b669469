"""The last record of every id as a table that grows with what lands, so that a training run does not sort all texts.

The table lies in buckets by a hash of the id. A merge takes the landed files that it has not taken yet, keeps the
last record of their ids and of the buckets that these ids fall into, and writes those buckets anew; all others
stay. Rows of these buckets whose id has surely not landed again are copied by the task that reads them, so that only
what landed, and what it may replace, is compared and moved. A manifest, written last, names the live folder of every bucket and the files that are in the table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.lookup import FILTER_BITS, filter_word, filter_words, passes
from credence.operators.normalize import last_numbers, numbered_rows
from credence.session import short_lived, stage
from credence.sources.compact import Files, landed_files
from credence.sources.files import LANDED, json_lines

BUCKETS = 256
ORDER = ("dt", "ingested_at", "seq")


def _state(spark: SparkSession, base: str) -> tuple[int, dict]:
    names = Files(spark, base).names(f"{base}/manifest")
    if not names:
        return 0, {"buckets": BUCKETS, "live": {}, "files": []}
    text = spark.read.text(f"{base}/manifest/{names[-1]}", wholetext=True).first()["value"]
    return int(names[-1].split(".")[0]), json.loads(text)


def merge_landed(spark: SparkSession, root: str, base: str, order: Sequence[str] = ORDER, buckets: int | None = None) -> list[int]:
    """Brings the table below ``base`` up to what has landed below ``root``; the buckets that were written anew.

    ``buckets`` counts for the first merge only. Of two merges at the same time one fails.
    """
    version, state = _state(spark, base)
    n = buckets if buckets and not version else state["buckets"]
    fresh = sorted(set(landed_files(spark, root)) - set(state["files"]))
    if not fresh:
        return []
    bucket = F.pmod(F.xxhash64("id"), F.lit(n))
    folder = f"{base}/data/{version + 1:012d}-{spark.sparkContext.applicationId}"
    with short_lived(spark):
        rows = json_lines(spark, LANDED).option("basePath", root).json(fresh).withColumn("bucket", bucket)
        landed = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "landed-rows")
        touched = sorted(r["bucket"] for r in landed.select("bucket").distinct().collect())        # at most one per bucket
        old = [state["live"][str(b)] for b in touched if str(b) in state["live"]]
        if old:
            words = filter_words(landed.select(F.xxhash64("id").alias("_id")), FILTER_BITS, "landed-ids")
            before = spark.read.schema(LANDED).parquet(*old).withColumn("bucket", bucket).withColumn("_id", F.xxhash64("id"))
            before = before.withColumn("_word", filter_word(FILTER_BITS)).join(words, "_word", "left").withColumn("_again", F.coalesce(passes(), F.lit(False)))
            again = before.where("_again").select(*rows.columns, (-1 - F.monotonically_increasing_id()).alias("_row"))
            landed = landed.unionByName(stage(again, "landed-again"))
        new = numbered_rows(landed, last_numbers(landed, order)).hint("rebalance", "bucket")
        if old:
            new = new.unionByName(before.where("NOT _again").select(*rows.columns))
        new.write.mode("overwrite").partitionBy("bucket").parquet(folder, compression="zstd")
    live = {**state["live"], **{str(b): f"{folder}/bucket={b}" for b in touched}}
    text = json.dumps({"buckets": n, "live": live, "files": sorted([*state["files"], *fresh])}, indent=1)
    Files(spark, base).create(f"{base}/manifest/{version + 1:012d}.json", text)
    return touched


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """One record per id, with the columns that order them."""
    _, state = _state(spark, base)
    if not state["live"]:
        return spark.createDataFrame([], LANDED)
    return spark.read.schema(LANDED).parquet(*state["live"].values())
