"""Terms in blocks and groups: the same numbers as from formulas, whatever the cuts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from credence.functions.stopwords import ENGLISH
from credence.operators import blocks as B
from credence.operators import features, models
from credence.plans import train as T

ROWS = [(f"k{i}", "kaggle", f"alpha {'beta' if i % 2 else 'gamma'} w{i % 7} the w{i % 5} alpha own{i}", i % 2) for i in range(40)]
ROWS += [(f"l{i}", "liar", f"claim {'left' if i % 3 else 'right'} side{i % 4} x{i}", int(i % 3 == 0)) for i in range(30)]
ROWS += [ROWS[0], ROWS[0], ROWS[45]]         # rows of one id are one document


def grams(text):
    words = [w for w in re.findall(r"\w{2,}", text) if w not in ENGLISH]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def expected(train, least):
    sizes, df = Counter(r["route"] for r in train), Counter((r["route"], t) for r in train for t in grams(r["input"]))
    idf = {k: math.log((1 + sizes[k[0]]) / (1 + n)) + 1 for k, n in df.items() if least[k[0]] <= n <= 0.9 * sizes[k[0]]}
    docs, sums = defaultdict(list), defaultdict(lambda: [0.0, 0.0])
    for r in train:
        docs[r["route"], r["id"], r["label"]] += [((r["route"], t), (1 + math.log(n)) * idf[r["route"], t]) for t, n in grams(r["input"]).items() if (r["route"], t) in idf]
    for (_, _, label), x in docs.items():
        norm = math.sqrt(sum(v * v for _, v in x))
        for k, v in x:
            sums[k][label] += v / norm
    return idf, dict(sums)


@pytest.mark.parametrize("entries, terms", [(1 << 20, 1 << 19), (20, 30)])
def test_sums_and_vectors_equal_the_formula(spark, monkeypatch, entries, terms):
    monkeypatch.setattr(B, "ENTRIES", entries)
    monkeypatch.setattr(B, "GROUP_TERMS", terms)
    df = spark.createDataFrame(ROWS, "id string, source string, text string, label int")
    fitted = T.fit_features(df, min_df={"article": 2, "claim": 1})
    train = fitted.rows.where("NOT is_test").collect()
    idf, sums = expected(train, {"article": 2, "claim": 1})
    T.fit_naive_bayes(fitted)
    got = {(r["route"], r["term"]): r for r in fitted.sums.collect()}
    assert got.keys() == idf.keys() and fitted.vocabulary.count() == len(idf)
    for k, r in got.items():
        assert r["idf"] == pytest.approx(idf[k]) and [r["s0"], r["s1"]] == pytest.approx(sums[k])
    assert fitted.vectors is None                # naive Bayes moves no row per document and term
    T.with_vectors(fitted)
    again = models.nb_sums(fitted.vectors, fitted.vocabulary).collect()
    assert {(r["route"], r["term"]) for r in again} == idf.keys()
    assert all([r["s0"], r["s1"]] == pytest.approx(sums[r["route"], r["term"]]) for r in again)
    assert fitted.vectors.where(F.expr("indices <> array_sort(indices)")).count() == 0


def test_greatest_vocabulary_is_kept(spark):
    df = spark.createDataFrame(ROWS, "id string, source string, text string, label int")
    fitted = T.fit_features(df, min_df={"article": 1}, max_features=5)
    train = fitted.rows.where("NOT is_test").select("id", "label", "route", "input")
    want = features.fit_vocabulary(train, 5, {"article": 1}).select("route", "term", "idx", "df").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, fitted.vocabulary.select("route", "term", "idx", "df").collect()))
    assert T.fit_models(fitted, {T.NB: T.fit_naive_bayes}, "v")[1][T.NB].terms.count() == len(want)
