"""Pruning before the shuffle: no term that is frequent enough is lost, most others are not moved."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from credence.functions.text import term_counts
from credence.operators import features, prune


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["article", "claim"]), " ".join([f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))] + [f"once{i}x{k}" for k in range(15)]))
            for i in range(400)]
    rows += [("article", ""), ("claim", None)]
    df = spark.createDataFrame(rows, "route string, input string").repartition(5).select("route", term_counts(F.coalesce("input", F.lit("")), []).alias("terms"))
    return features.stage(df, "counted")


def frequencies(df):
    return {(r["route"], r["term"]): (r["df"], r["cf"]) for r in df.collect()}


@pytest.mark.parametrize("least", [{"article": 2, "claim": 2}, {"article": 3}, {"claim": 20, "article": 2}, {"article": 300, "claim": 2}])
@pytest.mark.parametrize("task, group, bits", [(4_000_000, 16_000_000, 27), (50, 500, 12)])
def test_frequent_terms_keep_their_counts(docs, monkeypatch, least, task, group, bits):
    monkeypatch.setattr(prune, "TASK_TERMS", task)
    monkeypatch.setattr(prune, "GROUP_TERMS", group)
    every = frequencies(features.document_frequency(docs))
    terms = features.explode_terms(docs, ["route"]).where("term IS NOT NULL")
    kept = prune.only_frequent(terms, prune.frequent_words(docs, least, bits), list(least), bits)
    assert kept.columns == terms.columns
    got = frequencies(kept.groupBy("route", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    assert all(every[k] == v for k, v in got.items())
    assert {k for k, (df, _) in every.items() if df >= least.get(k[0], 1)} <= set(got)
    if bits == 27:
        assert all(df >= least.get(k[0], 1) for k, (df, _) in got.items())


def test_a_group_takes_little_memory():
    """Hashes of one group, four bytes and a count each, are held and sorted in Python: four of them at a time in an executor."""
    assert 4 * prune.GROUP_TERMS * 48 < 1_000_000_000 and 4 * prune.TASK_TERMS * 48 < 1_000_000_000


def test_at_least_half_of_the_rows_stay_where_they_are(docs):
    least = {"article": 2, "claim": 2}
    terms = features.explode_terms(docs, ["route"]).where("term IS NOT NULL")
    def moved(df):
        """Rows after the map-side sums: one per partition and term."""
        return df.select(F.spark_partition_id().alias("p"), "route", "term").distinct().count()
    assert moved(prune.only_frequent(terms, prune.frequent_words(docs, least), list(least))) <= 0.5 * moved(terms)


def test_vocabulary_is_the_same_with_texts_or_counted_terms(spark):
    rows = [("article", "alpha beta gamma alpha"), ("article", "beta delta"), ("article", "gamma beta zeta"), ("claim", "one two"), ("claim", "two three")]
    docs = spark.createDataFrame(rows, "route string, input string")
    counted = docs.select("route", term_counts("input", features.ENGLISH).alias("terms"))
    plain = features.document_frequency(docs)
    for source in (docs, counted):
        got = features.fit_vocabulary(source, min_df={"article": 2}, max_df=1.0)
        want = plain.where("df >= 2 OR route = 'claim'")
        assert sorted(map(tuple, got.select("route", "term", "df", "cf").collect())) == sorted(map(tuple, want.collect()))


def test_no_terms_at_all(spark):
    docs = spark.createDataFrame([("article", [])], "route string, terms array<struct<term: string, tf: int>>")
    assert prune.frequent_words(docs, {"article": 2}).collect() == []
    assert features.document_frequency(docs, least={"article": 2}).collect() == []
