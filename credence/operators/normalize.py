"""Raw rows to article records: normalising, defaults, validation, union, deduplication, interleaving."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.functions.text import blank_null, strip
from credence.operators.ranking import row_numbers
from credence.schema import (ARTICLE, MAX_LENGTH, NA_WORDS, RELIABLE_GRADES, TEXT_FIELDS,
                             UNRELIABLE_GRADES)
from credence.session import stage

KEPT_WORDS = 1 << 22        # of 64 rows each that are broadcast


def null_na_words(df: DataFrame) -> DataFrame:
    """The reader's missing-value words become null in every string column."""
    return df.select(*[
        F.when(~F.col(f.name).isin(NA_WORDS), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def grade_label(grade: Column | str) -> Column:
    """Six truthfulness grades to 0 (reliable) or 1 (unreliable); null for any other word."""
    g = F.lower(strip(grade))
    return F.when(g.isin(RELIABLE_GRADES), 0).when(g.isin(UNRELIABLE_GRADES), 1)


def binary_label(raw: Column | str) -> Column:
    """``'1'``, ``'1.0'``, ``'0.7'`` to an int by truncation; null when blank, an error when not a number."""
    s = strip(raw)
    return F.when(s != "", F.when(s != "", s).cast("double").cast("int"))


def to_article(df: DataFrame, keep: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Select the article record and the columns to ``keep``; fields that are not given are blank, label and time null."""
    def field(f: T.StructField) -> Column:
        default = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None)
        return columns.get(f.name, default).cast(f.dataType).alias(f.name)
    return df.select(*[field(f) for f in ARTICLE.fields], *keep)


def normalize_articles(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the article CSV to records; rows without text or without a 0/1 label are dropped."""
    label = binary_label("label")
    return to_article(
        df, keep,
        id=F.concat(F.lit("kaggle-"), strip("id")), source=F.lit("kaggle"), title=strip("title"),
        text=strip("text"), author=strip("author"), label=label, label_raw=label.cast("string"),
        ingested_at=F.current_timestamp(),
    ).where((F.col("text") != "") & F.col("label").isin(0, 1))


def normalize_claims(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the claim TSV (with their ``split``) to records; the statement becomes the text."""
    return to_article(
        df, keep,
        id=F.concat(F.lit("liar-"), F.col("split"), F.lit("-"), strip("json_id")), source=F.lit("liar"),
        text=strip("statement"), speaker=strip("speaker"), party=strip("party"), subject=strip("subject"),
        context=strip("context"), state=strip("state"), label=grade_label("label"),
        label_raw=F.lower(strip("label")), ingested_at=F.current_timestamp(),
    ).where((F.col("text") != "") & F.col("label").isNotNull())


def with_defaults(df: DataFrame) -> DataFrame:
    """Title, text and metadata columns exist and are never null."""
    return df.withColumns({
        c: blank_null(c) if c in df.columns else F.lit("") for c in TEXT_FIELDS
    })


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def violations() -> Column:
    """Names of the fields that break the record limits; an empty array means valid."""
    def broken(field: str) -> Column:
        n = F.char_length(blank_null(field))
        bad = n > MAX_LENGTH[field]
        return F.when((n < 1) | bad if field == "text" else bad, F.lit(field))
    return F.array_compact(F.array(*[broken(f) for f in TEXT_FIELDS]))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``violations``)."""
    checked = df.withColumn("violations", violations())
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def keep_last(df: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """One row per key: the greatest by ``order``; of rows equal in it the greatest by a hash of the row. Null keys are one key.

    Only keys, order, hash and a number of the row are aggregated, map-side first, so that a key with a large share of all rows
    stays cheap. The numbers of the rows that stay are broadcast where they are few; the whole rows, of which each is
    looked up once, are read again and moved at most once. ``df`` is read twice and must give the same rows both times:
    pass a scan or a staged table.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.join(last_numbers(numbered, order, key), "_row", "left_semi").drop("_row")


def last_numbers(numbered: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """(_row): of ``keep_last``, the numbers ``_row`` of the rows that stay."""
    # The hash is named twice, so that the optimizer computes it below the aggregation, which then sorts no texts.
    hashed = F.xxhash64(*[c for c in numbered.columns if c != "_row"])
    narrow = numbered.select(key, "_row", *[c for c in order if c != key], hashed.alias("_hash"))
    last = narrow.groupBy(key).agg(F.max(F.struct(*order, "_hash", "_row")).alias("_last"), F.count("_hash").alias("_rows")).where("_rows > 0")
    return last.select("_last._row")


def numbered_rows(numbered: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is among ``numbers``, as bits: up to ``KEPT_WORDS`` words of 64 are broadcast, and no row is moved.

    The numbers of ``numbered`` are stored with its rows: it is read in another job than ``numbers`` were found in.
    """
    bit = F.col("_row").bitwiseAND(F.lit(63)).cast("int")
    word = F.shiftright("_row", 6).alias("_word")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = stage(numbers.select(word, one.alias("b")).groupBy("_word").agg(F.bit_or("b").alias("_bits")), "kept-rows")
    if words.count() <= KEPT_WORDS:
        words = F.broadcast(words)
    return numbered.withColumn("_word", word).join(words, "_word").where(F.call_function("bit_get", F.col("_bits"), bit) == 1).drop("_row", "_word", "_bits")


def interleave(df: DataFrame, seq: str, sources: Sequence[str], limit: int = 0, key: str = "id", sort: bool = True) -> DataFrame:
    """Round robin over the sources in the given order, each in ``seq`` order; exhausted ones drop out.

    Adds ``turn`` (position within the source), ``source_rank`` and ``place`` (from 1, in the round robin). The
    place follows from turn, rank and the rows per source, so ``limit`` (0: all rows) is a filter, not a
    sort of whole rows in one task. The result is sorted unless ``sort`` is false.
    """
    names = list(dict.fromkeys(sources))
    chosen = df.where(F.col("source").isin(names))
    counts = {r["source"]: r["n"] for r in chosen.groupBy("source").agg(F.count("*").alias("n")).collect()}    # one row per name at most
    rank = F.array_position(F.lit(names), F.col("source"))
    numbered = row_numbers(chosen.withColumn("source_rank", rank.cast("int")), ["source"], seq, "turn", ties=[key])
    turn, mine = F.col("turn"), F.col("source_rank")
    before = [F.least(F.lit(counts.get(s, 0)), turn - 1) + ((mine > i + 1) & (turn <= counts.get(s, 0))).cast("bigint") for i, s in enumerate(names)]
    out = numbered.withColumn("place", (reduce(lambda a, b: a + b, before) + 1).cast("bigint"))
    out = out.where(F.col("place") <= limit) if limit else out
    return out.orderBy("place") if sort else out
