"""Term lookups: head, filter and tail give what one broadcast gives, without a hot key among what is shuffled."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from credence.operators import features, models
from credence.operators import lookup as L
from credence.operators.lookup import lookup


def corpus(spark, n=300):
    """One term in every document, some in many, most in few; half of the words are unknown to the table."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = ["common"] + [f"w{min(int(rng.paretovariate(0.7)), 4000)}" for _ in range(rng.randint(0, 40))] + [f"new{rng.randint(0, 10**6)}" for _ in range(20)]
        rows.append((f"d{i}", rng.choice(["article", "claim"]), " ".join(words)))
    rows += [("empty", "article", ""), ("unknown", "claim", "zzz yyy")]
    return spark.createDataFrame(rows, "id string, route string, input string").repartition(4)


@pytest.fixture(scope="module")
def known(spark):
    docs = corpus(spark)
    df = features.document_frequency(docs).where("term NOT LIKE 'new%' AND term NOT LIKE '% %' AND term NOT IN ('zzz', 'yyy')")
    table = df.select("route", "term", features.smooth_idf(F.col("df"), F.lit(150)).alias("idf"))
    path = features.stage(table, "known")
    return docs, path


def rows(df):
    return sorted((r["id"], r["route"], r["term"] or "", r["tf"], r["x"] and round(r["x"], 9)) for r in df.collect())


@pytest.mark.parametrize("head_bytes, bits", [(0, 20), (3000, 20), (3000, 8), (10**9, 20)])
def test_same_rows_as_one_broadcast(spark, known, head_bytes, bits):
    docs, table = known
    whole = features.weighted_terms(docs, ["id"], lookup(table))
    cut = lookup(table, limit=0, head_bytes=head_bytes, bits=bits)
    assert not cut.whole and lookup(table).whole
    assert rows(features.weighted_terms(docs, ["id"], cut)) == rows(whole)
    assert sorted(map(tuple, cut.table().collect())) == sorted(map(tuple, table.collect()))
    assert sorted(map(tuple, cut.select("route", "term").table().collect())) == sorted(map(tuple, table.select("route", "term").collect()))


def test_unknown_terms_and_frequent_ones_are_not_shuffled(spark, known):
    docs, table = known
    cut = lookup(table, limit=0, head_bytes=3000)
    terms = features.explode_terms(docs, ["id", "route"]).where("term IS NOT NULL")
    sent = cut.candidates(terms)
    assert sent.where("term LIKE 'new%'").count() <= 0.01 * terms.where("term LIKE 'new%'").count()
    assert sent.where("term = 'common'").count() == 0 and cut.head.where("term = 'common'").count() == 2
    parts = [r["n"] for r in sent.groupBy(F.pmod(F.hash("_id", "route", "term"), F.lit(8)).alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 8 and max(parts) <= 3 * sorted(parts)[4]


def test_tail_is_joined_by_its_id(spark, known):
    docs, table = known
    cut = lookup(table, limit=0, head_bytes=3000)
    terms = features.explode_terms(docs, ["id", "route"]).where("term IS NOT NULL")
    plan = cut.candidates(terms).join(cut.tail.hint("merge"), ["_id", *L.KEYS])._jdf.queryExecution().toString()
    assert "SortMergeJoin [_id" in plan


def test_empty_table(spark):
    docs = corpus(spark, 5)
    none = spark.createDataFrame([], "route string, term string, idf double")
    found = features.weighted_terms(docs, ["id"], lookup(none))
    assert found.where("term IS NOT NULL").count() == 0 and found.count() == 7


def test_scores_do_not_depend_on_the_lookup(spark, known):
    docs, table = known
    terms = features.stage(table.withColumn("weight", F.length("term") - 3.0), "weights")
    bias = {"article": 0.1, "claim": -0.2}
    whole = models.CredibilityModel("m", "v", terms, bias)
    cut = models.CredibilityModel("m", "v", terms, bias, lookup=lookup(terms, limit=0, head_bytes=2000))
    inputs = docs.select("id", F.col("input").alias("text"))
    def of(model):
        return sorted((r["id"], r["label"], r["confidence"], [tuple(t) for t in r["top_terms"]]) for r in models.score(inputs, model).collect())
    assert of(whole) == of(cut)
