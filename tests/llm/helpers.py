"""Shared inputs: documents with the awkward cases, and plain-Python words."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names clash with those the operators use inside.
CLASHING = "k int, t string, th long, n int, row int, score double, s1 long, block long, component int, host string, sequence_id int"


def prose(seed: int, n: int, words: int = 400) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def awkward(extra: bool = True) -> list[tuple]:
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1),                      # a repeated row
        (2, base.upper(), "en", "a", 1), (3, base + " more", None, "a", 1),   # copies
        (None, base, "en", None, None), (None, None, None, None, None),
        (4, None, "en", "a", 0), (5, "", "de", "a", 0), (6, "   \n\t ", "de", "a", 0), (7, "1234 !!! ???", "fr", "b", 1),
        (8, "one", "en", "b", 1), (9, "one two three", "en", "b", 1), (10, "ONE two\nthree", "en", "b", 1),
        (11, "x" * 3000, "en", "b", 1), (12, prose(2, 30_000), "en", "b", 1), (13, "Été ñandú straße 中文 <|endoftext|> it's", "fr", "b", 1),
        (14, "a\x00b  c d\r\ne", "en", "b", 1), (-15, prose(3, 300), "en", "b", 1),
    ]
    return rows


def documents(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward() if rows is None else rows, DOCUMENTS).repartition(3)
    if clash:
        for part in CLASHING.split(", "):
            name, kind = part.split(" ")
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
