"""Topics: JSON values keyed by id, over a broker connector or, with the same records, over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators.normalize import with_defaults
from credence.schema import ARTICLE, META_FIELDS
from credence.sources.files import or_empty

# Default topic names.
TOPIC_ARTICLES = "news-articles"
TOPIC_INCOMING = "news-incoming"
TOPIC_PREDICTIONS = "news-predictions"

RECORD = "key string, value string"
# Fixed values, producer settings: wait for all replicas, compress, allow records of up to 5 MiB.
PRODUCER = {"kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.linger.ms": "20",
            "kafka.max.request.size": str(5 * 1024 * 1024)}


def to_records(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, value): the row as JSON, nulls left out, non-ASCII kept."""
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def from_records(df: DataFrame, schema: T.StructType = ARTICLE) -> DataFrame:
    parsed = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return df.select(parsed.alias("r")).select("r.*")


def read_topic(spark: SparkSession, topic: str, schema: T.StructType = ARTICLE, format: str = "kafka",
               starting: str = "earliest", limit: int | None = None, path: str | None = None, **options) -> DataFrame:
    """Streaming frame of a topic's records; ``limit`` throttles each trigger (offsets, or files).

    ``format`` 'kafka' needs the connector on the class path and ``kafka.bootstrap.servers``; 'parquet'
    and 'json' read (key, value) records that ``write_records`` put into ``path``.
    """
    reader = spark.readStream.format(format).options(**options)
    if format == "kafka":
        reader = reader.option("subscribe", topic).option("startingOffsets", starting)
        return from_records((reader.option("maxOffsetsPerTrigger", limit) if limit else reader).load(), schema)
    if limit:
        reader = reader.option("maxFilesPerTrigger", limit)
    return from_records(reader.schema(RECORD).load(f"{path}/{topic}"), schema)


def write_records(df: DataFrame, topic: str, format: str = "kafka", path: str | None = None, key: str = "id",
                  **options) -> None:
    """Append a batch to a topic."""
    writer = to_records(df, key).write.format(format).mode("append").options(**options)
    if format == "kafka":
        writer.options(**{**PRODUCER, **options}).option("topic", topic).save()
    else:
        writer = writer.options(**{"compression": "zstd", **options}) if format == "parquet" else writer
        writer.save(f"{path}/{topic}")


def delivered(spark: SparkSession, topic: str, batch: int, since: float, format: str = "kafka", path: str | None = None, **options) -> DataFrame:
    """(delivery): of the records of a scoring batch those that the topic holds. ``since``: seconds, none is older."""
    schema = T.StructType([T.StructField("delivery", T.StringType())])
    reader = spark.read.format(format).options(**options)
    if format == "kafka":
        found = reader.option("subscribe", topic).option("startingTimestamp", str(int(since * 1000))).option("startingOffsetsByTimestampStrategy", "latest").load()
    else:
        found = or_empty(spark, lambda: reader.schema(RECORD).load(f"{path}/{topic}"), T.StructType.fromDDL(RECORD))
    return from_records(found, schema).where(F.col("delivery").startswith(f"{batch}-")).distinct()


def live_records(df: DataFrame) -> DataFrame:
    """Submitted articles as incoming records with a fresh id; blank metadata is left out.

    The id is random, so write the result once and read it back before using the id elsewhere.
    """
    fresh = F.concat(F.lit("live-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
    rows = with_defaults(df)
    return rows.select(fresh.alias("id"), F.lit("live").alias("source"), "title", "text",
                       *[F.nullif(F.col(f), F.lit("")).alias(f) for f in META_FIELDS],
                       F.current_timestamp().alias("ingested_at"))


def ingest(df: DataFrame, format: str = "kafka", path: str | None = None, topic: str = TOPIC_INCOMING, **options) -> None:
    """Append submitted articles to the incoming topic; a scoring stream picks them up."""
    write_records(live_records(df), topic, format, path, **options)


def sent_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("sent"))
