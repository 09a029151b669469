"""File sources: article CSV, claim TSV, landed JSON lines; and the JSON-lines sink."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions.text import WS
from credence.operators.normalize import normalize_articles, normalize_claims, null_na_words, union_all
from credence.schema import ARTICLE, ARTICLE_CSV_COLUMNS, CLAIM_SPLITS, CLAIM_TSV_COLUMNS, RECORD, ROUTE_OF_SOURCE
from credence.sources.quoted import read_quoted_csv

LANDED = T.StructType([*RECORD.fields, T.StructField("dt", T.DateType())])


def strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def with_place(schema: T.StructType, place: str | None) -> T.StructType:
    """The schema with a column for the place of a row: file, start of its byte range, number there."""
    if place is None:
        return schema
    at = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
    return T.StructType([*schema.fields, T.StructField(place, at)])


def or_empty(spark: SparkSession, read, schema: T.StructType) -> DataFrame:
    """The result of ``read()``, or no rows and a warning when its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            warnings.warn(f"no rows were read: {e.getMessage()}", stacklevel=3)
            return spark.createDataFrame([], schema)
        raise


def read_article_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """All-string rows of the article CSV: quoted newlines, doubled quotes, missing-value words as null.

    The header of every file is compared with the expected columns when the file is read; another one is an
    error. Large files are read by many tasks, see ``quoted``; ``place`` names a column for a row's place.
    """
    def read() -> DataFrame:
        return read_quoted_csv(spark, path, ARTICLE_CSV_COLUMNS, place)
    return null_na_words(or_empty(spark, read, with_place(strings(ARTICLE_CSV_COLUMNS), place)))


def read_claim_tsv(spark: SparkSession, path: str, split: str, place: str | None = None) -> DataFrame:
    """Rows of a 14-column TSV without header or quoting; longer lines are skipped, shorter ones padded.

    ``place`` names a column for a row's place.
    """
    schema = with_place(strings(CLAIM_TSV_COLUMNS), place)
    at = [F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                   F.monotonically_increasing_id().alias("n")).alias(place)] if place else []
    def read() -> DataFrame:
        cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
        lines = spark.read.text(path, lineSep="\n").where(~F.col("value").rlike(f"^[{WS}]*$"))
        return (lines.select(cells.alias("c"), *at).where(F.size("c") <= len(CLAIM_TSV_COLUMNS))
                .select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(CLAIM_TSV_COLUMNS)], *([place] if place else [])))
    return null_na_words(or_empty(spark, read, schema)).withColumn("split", F.lit(split))


def source_names(names: Sequence[str]) -> list[str]:
    """Names without blanks around them; one that is no raw data set is an error."""
    found = [n.strip() for n in names]
    if unknown := [n for n in found if n not in ROUTE_OF_SOURCE]:
        raise ValueError(f"unknown sources {unknown}, expected {list(ROUTE_OF_SOURCE)}")
    return found


def load_raw(spark: SparkSession, root: str, sources: Sequence[str] = ("kaggle", "liar"), place: str | None = None) -> DataFrame:
    """The named raw data sets below ``root`` as article records; missing files contribute nothing but a warning.

    ``place`` names a column whose order is that of the data sets, their files, and the rows in these.
    """
    sources = source_names(sources)
    keep = [place] if place else []
    parts = [spark.createDataFrame([], T.StructType(with_place(ARTICLE, place).fields))]
    if "kaggle" in sources:
        parts.append(normalize_articles(read_article_csv(spark, f"{root}/kaggle/train.csv", place), keep))
    if "liar" in sources:
        parts += [normalize_claims(read_claim_tsv(spark, f"{root}/liar/{s}.tsv", s, place), keep) for s in CLAIM_SPLITS]
    if place:       # the data sets in the order in which they were named here
        parts = [p.withColumn(place, F.struct(F.lit(i).alias("part"), F.col(place).alias("at"))) for i, p in enumerate(parts)]
    return union_all(*parts)


def read_landed(spark: SparkSession, root: str, schema: T.StructType = LANDED, glob: str = "*.json*") -> DataFrame:
    """Date-partitioned JSON lines; lines end at \\n only. No rows when the root does not exist.

    ``dt`` is the partition column: a filter on it prunes directories.
    """
    def read() -> DataFrame:
        return json_lines(spark, schema, glob).json(root)
    return or_empty(spark, read, schema)


def json_lines(spark: SparkSession, schema: T.StructType, glob: str = "*.json*") -> DataFrameReader:
    return (spark.read.schema(schema).option("lineSep", "\n").option("pathGlobFilter", glob).option("mode", "FAILFAST"))


def write_landed(df: DataFrame, root: str, mode: str = "append") -> None:
    """Append as JSON lines below ``dt=<UTC date of writing>``."""
    df.withColumn("dt", F.to_date(F.current_timestamp())).write.mode(mode).partitionBy("dt").json(root)
