"""Record layouts and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Names, prefixes, grades and limits that define the data model.
META_PREFIX = {"speaker": "spk", "party": "party", "subject": "subj", "context": "ctx", "state": "st"}
META_FIELDS = list(META_PREFIX)
TEXT_FIELDS = ["title", "text", *META_FIELDS]
LABELS = {0: "reliable", 1: "unreliable"}
RELIABLE_GRADES = ["true", "mostly-true", "half-true"]
UNRELIABLE_GRADES = ["barely-true", "false", "pants-fire"]
ARTICLE_CSV_COLUMNS = ["id", "title", "author", "text", "label"]
CLAIM_TSV_COLUMNS = [
    "json_id", "label", "statement", "subject", "speaker", "job_title", "state",
    "party", "barely_true_counts", "false_counts", "half_true_counts",
    "mostly_true_counts", "pants_on_fire_counts", "context",
]
CLAIM_SPLITS = ["train", "valid", "test"]
ROUTE_OF_SOURCE = {"kaggle": "article", "liar": "claim"}
MAX_LENGTH = {"title": 1_000, "text": 200_000, "speaker": 200, "party": 100, "subject": 300,
              "context": 300, "state": 100}
CLAIM_MAX_WORDS = 60
MIN_DF = {"article": 2, "claim": 1}
MAX_DF = 0.9
LR_C = {"article": 10.0, "claim": 1.0}
LR_MAX_ITER = 3_000
LR_TOL = 1e-8
NB_ALPHA = 0.1
TEST_SIZE = 0.2
SEED = 42
THRESHOLD = 0.5
EXPLAIN_K = 8
VOCABULARY_K = 20

# Words a CSV/TSV reader treats as missing (the documented pandas defaults).
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("party", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("label_raw", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
])

# An article on its way through a topic and a landing folder: with its place in what was sent.
RECORD = T.StructType([*ARTICLE.fields, T.StructField("seq", T.LongType())])

TERM = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("direction", T.StringType()),
])

PREDICTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("submitted_at", T.TimestampType()),
    T.StructField("scored_at", T.TimestampType()),
    T.StructField("model", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("label_id", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("route", T.StringType()),
    T.StructField("top_terms", T.ArrayType(TERM)),
])
