"""The driver's tables as article records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.normalize import to_article, union_all
from credence.functions.text import strip

TABLE_ROUTES = {"article": "article", "claim": "claim"}
SOURCES = ["article", "claim", "page", "conversation", "benchmark"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A scan of the table. ``credence.scan.partitions`` in the session deals its rows out evenly, for small
    tables of a single row group; by default the splits are those of the files."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("credence.scan.partitions", None)
    return scan.repartition(int(parts)) if parts else scan


def labelled_articles(spark: SparkSession, sf_dir: str, labelled_only: bool = True) -> DataFrame:
    """``documents`` with ``labels``: English rows are articles, the others claims with metadata."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "inner" if labelled_only else "left")
    claim = F.col("lang") != "en"
    label = 1 - F.col("quality")
    def on_claim(c):
        return F.when(claim, c).otherwise("")
    return to_article(
        rows,
        id=F.concat(F.when(claim, "claim-").otherwise("doc-"), F.col("doc_id").cast("string")),
        source=F.when(claim, "claim").otherwise("article"), text=strip("text"),
        speaker=on_claim(F.col("source")), subject=on_claim(F.col("lang")),
        label=label, label_raw=label.cast("string"),
    ).where("text <> ''")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return to_article(
        table(spark, sf_dir, "pages"), id=F.concat(F.lit("page-"), F.col("page_id").cast("string")),
        source=F.lit("page"), title=strip(title), text=strip("html")).where("text <> ''")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_article(
        table(spark, sf_dir, "conversations"), id=F.concat_ws("-", F.lit("conv"), "conv_id", "turn"),
        source=F.lit("conversation"), text=strip("text"), speaker=strip("role")).where("text <> ''")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_article(
        table(spark, sf_dir, "benchmark"), id=F.concat(F.lit("bench-"), F.col("item_id").cast("string")),
        source=F.lit("benchmark"), text=strip("text")).where("text <> ''")


def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(labelled_articles(spark, sf_dir, labelled_only=False), pages(spark, sf_dir),
                     conversations(spark, sf_dir), benchmark(spark, sf_dir))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a feed of verdicts: (id, scored_at, label, confidence)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("scored_at"),
        F.when(F.col("event_type") == "error", "unreliable").otherwise("reliable").alias("label"),
        F.col("value").alias("confidence"))
