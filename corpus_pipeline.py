"""A corpus pipeline over ``documents``: toxicity, language, near copies, benchmark passages, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``, whatever further columns there are, and only drop rows:

* toxicity (6): rows that score 0.5 or more go; the machine is fitted on ``labels``. Null and empty texts score low.
* language (1): rows that are like none of the languages named in the table go, that is a cosine with every prototype
  below what unrelated text has by chance; so do null texts and those without letters.
* near copies (10): of each group of documents whose sets of 5-word shingles are linked by a similarity of 0.8
  or more, directly or through others, the one with the least doc_id stays; rows without words stay.
* benchmark (3): rows that hold a benchmark window go.
* packing (8): no row goes; the result is the documents' pieces and their sequences.

Null doc_ids and rows that repeat another are rows like any other: of repeated rows with words one stays, as
of other copies. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontaminate, jaccard, lang_id, packing, toxicity
from credence.llm.common import table
from credence.session import stage

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
MEMO_PIECES = 200_000       # fewer than packing alone remembers: the workers have held other models before


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.harmless(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lang_id.identified(docs, lang_id.learn(docs))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.join(docs, n_words=SHINGLE_WORDS, threshold=SIMILARITY).where("keep").select("doc_id", "text_hash", "n_shingles")
    kept = stage(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_rows"), F.max("n_shingles").alias("_shingles")), "kept")

    def rows_of(keys: DataFrame) -> DataFrame:
        """Rows by key and text. ``kept`` is about as long as the documents, so both sides are shuffled."""
        wanted = keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")

    repeated = (F.col("_rows") > 1) & (F.col("_shingles") > 0)
    out = rows_of(kept.where(~repeated))
    if kept.where(repeated).limit(1).count():       # one of the rows that repeat the document that stays
        out = out.unionByName(rows_of(kept.where(repeated)).dropDuplicates(["doc_id", "text"]))
    return out


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, memo=MEMO_PIECES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_copies", near_copies_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None       # learned models and a tokenizer are beyond SQL; tests hold the rows against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
