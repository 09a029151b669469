"""Structured Streaming jobs: land articles, score the incoming stream, rate the feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from credence.operators.models import CredibilityModel, score
from credence.plans.registry import reload_if_changed, wait_for_model
from credence.plans.report import window_rates
from credence.schema import PREDICTION
from credence.session import short_lived, stage

FLUSH = "15 seconds"
ARCHIVE = "10 seconds"


def _trigger(until_idle: bool, interval: str) -> dict:
    """Everything available and then stop, or run on with one micro-batch per interval."""
    return {"availableNow": True} if until_idle else {"processingTime": interval}


def land(stream: DataFrame, root: str, checkpoint: str, until_idle: bool = False, interval: str = FLUSH) -> StreamingQuery:
    """Land a stream of articles as JSON lines below ``dt=<UTC write date>``.

    The file sink's log and the checkpoint make every record appear once.
    """
    return (stream.withColumn("dt", F.to_date(F.current_timestamp()))
            .writeStream.format("json").partitionBy("dt").option("path", root)
            .option("checkpointLocation", checkpoint).trigger(**_trigger(until_idle, interval))
            .queryName("land-articles").start())


def _mark(spark: SparkSession, path: str) -> None:
    """An empty file; one step that either happened or did not."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True).close()


def _marked(spark: SparkSession, path: str) -> float | None:
    """Seconds at which the file was made, None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime() / 1000 if fs.exists(at) else None


def score_stream(stream: DataFrame, registry: list[str], archive: str, checkpoint: str,
                 publish: Callable[[DataFrame], None] | None = None, until_idle: bool = False,
                 interval: str = ARCHIVE, wait_seconds: float = 0,
                 delivered: Callable[[int, float], DataFrame] | None = None) -> StreamingQuery:
    """Score every micro-batch with the current model, archive the predictions, and publish them.

    Before it starts, the job waits up to ``wait_seconds`` for a model. Each micro-batch checks the registry's
    pointer, so a newly published model is used from the next one on. A batch is archived below its date
    and number, ``dt=.../batch=N``, each prediction with a ``delivery``, "N-row"; then the ledger beside the checkpoint
    is marked, the archived rows are published, and the ledger is marked again. A batch that is repeated, because the
    job stopped before Spark committed it, is not scored anew: it publishes, from the archive, what the topic
    lacks. ``delivered(N, since)`` tells what that is; without it everything is sent again unless the ledger says that all was.
    """
    current: list[CredibilityModel] = [wait_for_model(stream.sparkSession, *registry, seconds=wait_seconds)]

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        archived, sent = (f"{checkpoint}/ledger/{number}.{step}" for step in ("archived", "sent"))
        if _marked(spark, sent) is not None:
            return
        with short_lived(spark):
            since = _marked(spark, archived)
            if since is None:
                current[0] = reload_if_changed(current[0], spark, *registry)
                rows = score(batch, current[0]).withColumn("delivery", F.concat(F.lit(f"{number}-"), F.monotonically_increasing_id()))
                predictions = stage(rows, "predictions")     # two sinks, scored once
                (predictions.withColumn("dt", F.to_date("scored_at")).withColumn("batch", F.lit(number))
                 .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").json(archive))
                _mark(spark, archived)
            if publish:
                if since is None:
                    missing = predictions
                else:       # as the batch was scored then
                    schema = StructType([*PREDICTION.fields, StructField("delivery", StringType())])
                    whole = spark.read.schema(StructType([*schema.fields, StructField("dt", DateType()), StructField("batch", LongType())])).json(archive)
                    missing = whole.where(F.col("batch") == number).drop("dt", "batch")
                    if delivered:       # written down before anything is sent: what is sent must not change what is missing
                        missing = stage(missing.join(delivered(number, since), "delivery", "left_anti").select(*schema.names), "missing")
                publish(missing)
            _mark(spark, sent)

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**_trigger(until_idle, interval)).queryName("score-incoming").start())


def rate_stream(feed: DataFrame, delay: str = "1 minute", minutes: int = 1) -> DataFrame:
    """Verdicts and flag rate per clock-aligned minute of a stream; a window is final once the watermark passes."""
    return window_rates(feed.withWatermark("scored_at", delay), minutes)


def drop_repeats(stream: DataFrame, time: str = "ingested_at", delay: str = "1 hour", key: str = "id") -> DataFrame:
    """Drop records that are delivered again within ``delay``; state is kept only that long."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
