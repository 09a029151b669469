"""The four jobs of the application, each one call: publish articles, land them, train, score the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.operators.models import CredibilityModel, require_model
from credence.operators.normalize import interleave, keep_last
from credence.operators.ranking import sorted_numbers
from credence.plans.registry import load_latest, metrics_document, publish
from credence.plans.train import train
from credence.session import short_lived, stage
from credence.schema import RECORD
from credence.sources.compact import read_live
from credence.sources.files import load_raw, source_names
from credence.sources.topic import (TOPIC_ARTICLES, TOPIC_INCOMING, TOPIC_PREDICTIONS, delivered, read_topic, write_records)
from credence.streaming.jobs import land, score_stream


def produce(spark: SparkSession, raw: str, sources: Sequence[str] = ("kaggle", "liar"), limit: int = 0,
            topic: str = TOPIC_ARTICLES, **where) -> DataFrame:
    """Normalise the raw data sets, interleave them, append them to the topic; returns the rows sent per source.

    The rows are counted while they are written.
    ``where``: ``format`` and its options, as for ``write_records``.
    """
    names = source_names(sources)
    rows = sorted_numbers(load_raw(spark, raw, names, place="place"), [], ["place"], "row", "bigint").drop("place")
    rows = stage(rows, "raw")
    # A topic keeps no order between keys: each record carries its place instead, and nothing is sorted.
    sent = interleave(rows, "row", names, limit, sort=False).withColumnRenamed("place", "seq").drop("row", "turn", "source_rank")
    seen = Observation("sent")
    write_records(sent.observe(seen, *[F.count_if(F.col("source") == n).alias(n) for n in dict.fromkeys(names)]), topic, **where)
    counts = [(n, c) for n, c in seen.get.items() if c]
    return spark.createDataFrame(counts, "source string, sent long")


def sink(spark: SparkSession, root: str, checkpoint: str, until_idle: bool = False, rate: int | None = None,
         topic: str = TOPIC_ARTICLES, **where) -> StreamingQuery:
    """Land the article topic, each record with its place in what was sent; ``rate`` limits what one micro-batch takes."""
    return land(read_topic(spark, topic, RECORD, limit=rate, **where), root, checkpoint, until_idle)


def latest_articles(landed: DataFrame) -> DataFrame:
    """One record per id: the one landed last, by date, ingestion time and place (``seq``) in what was sent."""
    return keep_last(landed, ["dt", "ingested_at", "seq"]).drop("dt", "seq")


def train_and_publish(articles: DataFrame, base: str | None, data_source: str, **options) -> tuple[CredibilityModel, dict]:
    """Train both classifiers and publish the better one below ``base`` (None: do not publish)."""
    if not base:
        trained = train(articles, **options)
        document = metrics_document(trained, data_source, options.get("route_of_source"))
        best = trained.models[document["best_model"]]
        best.metrics = document
        return best, document
    spark = articles.sparkSession
    with short_lived(spark):        # what the training staged goes once the model is published
        trained = train(articles, **options)
        document = metrics_document(trained, data_source, options.get("route_of_source"))
        publish(trained.models[document["best_model"]], base, document)
    return require_model(load_latest(spark, base)), document


def train_from_landed(spark: SparkSession, root: str, base: str | None, **options) -> tuple[CredibilityModel, dict]:
    return train_and_publish(latest_articles(read_live(spark, root)), base, root, **options)


def train_from_raw(spark: SparkSession, raw: str, base: str | None, **options) -> tuple[CredibilityModel, dict]:
    return train_and_publish(latest_raw(spark, raw), base, raw, **options)


def latest_raw(spark: SparkSession, raw: str) -> DataFrame:
    """The raw data sets with one record per id, the last by file and position."""
    return keep_last(stage(load_raw(spark, raw, place="place"), "raw"), ["place"]).drop("place")


def score_incoming(spark: SparkSession, registry: Sequence[str], archive: str, checkpoint: str, until_idle: bool = False,
                   starting: str = "latest", wait_seconds: float = 0, **where) -> StreamingQuery:
    """Score the incoming topic; predictions go to their topic and to the archive. Waits for a model first."""
    stream = read_topic(spark, TOPIC_INCOMING, starting=starting, **where)
    return score_stream(stream, list(registry), archive, checkpoint, lambda p: write_records(p, TOPIC_PREDICTIONS, **where), until_idle,
                        wait_seconds=wait_seconds, delivered=lambda batch, since: delivered(spark, TOPIC_PREDICTIONS, batch, since, **where))
