"""Training: prepared rows -> split -> vocabulary -> vectors -> both classifiers -> metrics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from time import monotonic

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.stopwords import ENGLISH
from credence.functions.text import cut, meta_tokens, model_input, route_for, with_meta
from credence.operators.blocks import TermGroups, block_vectors, group_sums, term_blocks, term_groups
from credence.operators.evaluate import best_model, evaluate, routing_accuracy
from credence.operators.features import content, most_frequent, numbered, require_terms, smooth_idf
from credence.operators.lookup import TermLookup, lookup
from credence.operators.models import (CredibilityModel, by_route, class_counts, known_route, lr_weights, nb_bias, nb_sums, nb_weight,
                                       probabilities)
from credence.operators.normalize import with_defaults
from credence.operators.split import stratified_split
from credence.schema import MAX_DF, MIN_DF, NB_ALPHA, ROUTE_OF_SOURCE, SEED, TEST_SIZE
from credence.session import stage

LR, NB = "logistic_regression", "naive_bayes"


def source_route(route_of_source: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.when(F.col("source") == kv[0], kv[1]).otherwise(acc), route_of_source.items(),
                  F.lit(None).cast("string"))


def input_for(route: Column) -> Column:
    return with_meta(F.col("base"), F.col("meta"), route)


def prepare_training(articles: DataFrame, route_of_source: dict[str, str] | None = None, max_chars: int | None = None) -> DataFrame:
    """Staged (id, source, label, route by rule, fit_route by source, base, meta) without empty texts.

    ``base`` is the article input; the claim input adds ``meta``. The filter on the cleaned text
    follows the staging: before it, the optimizer would clean each text twice.
    """
    rows = (
        with_defaults(articles).where("label IS NOT NULL")
        .select("id", "source", F.col("label").cast("int").alias("label"), route_for().alias("route"),
                source_route(route_of_source or ROUTE_OF_SOURCE).alias("fit_route"),
                cut(model_input("title", "text"), max_chars).alias("base"),
                meta_tokens().alias("meta")))
    return stage(rows, "prepared").where("base <> ''")


@dataclass
class Fitted:
    """Everything the later steps share, computed once."""

    rows: DataFrame            # all rows with is_test, the route they are used under, and their input
    vocabulary: DataFrame      # its terms are numbered once there are vectors
    vectors: DataFrame | None  # training rows, made when they are first needed
    counts: list               # class counts per route, fallback route first
    stop_words: tuple[str, ...] | None
    max_chars: int | None = None
    sums: DataFrame | None = None       # per term and class, from the first naive Bayes fit on
    blocks: DataFrame | None = None     # training rows, their terms counted
    groups: TermGroups | None = None    # of these terms, where the vocabulary has all that are frequent enough


@dataclass
class Trained:
    fitted: Fitted
    models: dict[str, CredibilityModel]
    predictions: DataFrame     # (id, source, label, rule_route, route, model, p) of the test rows
    seconds: dict[str, float]
    version: str
    trained_at: datetime

    def metrics(self) -> DataFrame:
        return evaluate(self.predictions)


def fit_features(articles: DataFrame, route_of_source: dict[str, str] | None = None, test_size: float = TEST_SIZE,
                 seed: int = SEED, max_features: int | None = None, min_df: dict[str, int] | None = None,
                 max_df: float = MAX_DF, stop_words: Iterable[str] | None = None, max_chars: int | None = None) -> Fitted:
    """Split, vocabulary and training vectors; ``articles`` have unique ids (see ``keep_last``).

    ``max_chars`` and ``max_features`` are off by default: whole texts, and all terms that ``min_df`` and ``max_df`` leave.
    """
    routes = route_of_source or ROUTE_OF_SOURCE
    stop = None if stop_words is None else tuple(stop_words)
    prepared = prepare_training(articles, routes, max_chars)
    split = stratified_split(prepared, test_size=test_size, seed=seed)
    of_source = split.where(~F.col("is_test") & F.col("fit_route").isNotNull()).select(F.col("fit_route").alias("route"), "label")
    order = list(dict.fromkeys(routes.values()))
    counts = sorted(class_counts(of_source).collect(), key=lambda r: order.index(r["route"]))
    if not counts:
        raise ValueError("no training rows")
    for r in counts:
        if not (r["n0"] and r["n1"]):
            raise ValueError(f"route {r['route']!r} has training rows of one class only")
    # A row is learned from under its source's route and tested under the rule's.
    used = F.when(F.col("is_test"), known_route(F.col("route"), [r["route"] for r in counts])).otherwise(F.col("fit_route"))
    rows = split.withColumn("used", used).select(
        "id", "source", "label", "is_test", F.col("route").alias("rule_route"), F.col("used").alias("route"), input_for(F.col("used")).alias("input"))
    train = rows.where(~F.col("is_test") & F.col("route").isNotNull()).select("id", "label", "route", "input")
    blocks = term_blocks(train, stop_words=ENGLISH if stop is None else stop)
    sizes = {r["route"]: r["n"] for r in counts}
    groups = term_groups(blocks, sizes, {r: (MIN_DF if min_df is None else min_df).get(r, 1) for r in sizes}, max_df)
    require_terms(groups.table.where(F.length("df") > 0), sizes)
    terms = groups.terms().withColumn("n_docs", by_route(sizes).cast("bigint"))
    if max_features is not None:
        return Fitted(rows, numbered(most_frequent(stage(terms, "terms"), max_features)), None, counts, stop, max_chars, blocks=blocks)
    return Fitted(rows, terms.withColumn("idf", smooth_idf(F.col("df"), F.col("n_docs"))), None, counts, stop, max_chars, blocks=blocks, groups=groups)


def with_vectors(fitted: Fitted) -> Fitted:
    if fitted.vectors is None:
        fitted.vocabulary = fitted.vocabulary if "idx" in fitted.vocabulary.columns else numbered(fitted.vocabulary)
        fitted.vectors = block_vectors(fitted.blocks, fitted.vocabulary)
    return fitted


def fit_naive_bayes(fitted: Fitted, alpha: float = NB_ALPHA) -> tuple[Column, dict[str, float]]:
    if fitted.sums is None and fitted.groups:
        fitted.sums = group_sums(fitted.groups, {r["route"]: r["n"] for r in fitted.counts})
    elif fitted.sums is None:
        fitted.sums = nb_sums(with_vectors(fitted).vectors, fitted.vocabulary)
    return nb_weight(fitted.sums, alpha), nb_bias(fitted.counts)


def fit_logistic(fitted: Fitted, **options) -> tuple[DataFrame, dict[str, float]]:
    with_vectors(fitted)
    return lr_weights(fitted.vectors, fitted.vocabulary, fitted.counts, **options)


def fit_models(fitted: Fitted, fits: dict, version: str) -> tuple[TermLookup, dict[str, CredibilityModel], dict[str, float]]:
    """(one term table with a weight column per model, models, seconds to fit).

    A fit gives its weights as (route, idx, weight) or as a column over ``fitted.sums``.
    """
    tables, of_sums, bias, seconds = {}, {}, {}, {}
    for name, fit in fits.items():
        start = monotonic()
        weights, bias[name] = fit(fitted)
        (of_sums if isinstance(weights, Column) else tables)[name] = weights
        seconds[name] = round(monotonic() - start, 2)
    table = fitted.sums if of_sums else fitted.vocabulary
    table = table.select("route", "term", "idf", *[w.alias(f"w_{name}") for name, w in of_sums.items()])
    if tables:
        weights = fitted.vocabulary.select("route", "idx", "term")
        for name, w in tables.items():
            weights = weights.join(w.withColumnRenamed("weight", f"w_{name}"), ["route", "idx"])
        table = table.join(weights.drop("idx"), ["route", "term"])
    table = stage(table, "term-table")
    found = lookup(table)
    def columns(name: str) -> list[Column | str]:
        return ["route", "term", "idf", F.col(f"w_{name}").alias("weight")]
    models = {
        name: CredibilityModel(name, version, table.select(*columns(name)), bias[name], fitted.stop_words,
                               max_chars=fitted.max_chars, lookup=found.select(*columns(name)))
        for name in fits
    }
    return found.select("route", "term", "idf", *[f"w_{name}" for name in fits]), models, seconds


def predict_test(fitted: Fitted, table: TermLookup, models: dict[str, CredibilityModel]) -> DataFrame:
    """Test rows scored as production would: routed by the rule, not by their source."""
    docs = fitted.rows.where("is_test").select("id", "source", "label", "rule_route", "route", content(fitted.rows))
    return stage(
        probabilities(docs, table, {n: m.bias for n, m in models.items()}, ["source", "label", "rule_route"],
                      stop_words=fitted.stop_words),
        "predictions")


def train(articles: DataFrame, fits: dict | None = None, now: datetime | None = None, **options) -> Trained:
    """Fit both classifiers on shared features and score the test rows with each."""
    now = now or datetime.now(timezone.utc)
    version = now.strftime("%Y%m%dT%H%M%SZ")
    fitted = fit_features(articles, **options)
    table, models, seconds = fit_models(fitted, fits or {LR: fit_logistic, NB: fit_naive_bayes}, version)
    return Trained(fitted, models, predict_test(fitted, table, models), seconds, version, now)


def select_best(trained: Trained, metrics: DataFrame) -> CredibilityModel:
    return trained.models[best_model(metrics, list(trained.models)).first()["model"]]


def routing(trained: Trained, route_of_source: dict[str, str] | None = None) -> DataFrame:
    rule = trained.predictions.drop("route").withColumnRenamed("rule_route", "route")
    return routing_accuracy(rule, route_of_source)


def feature_counts(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary size per route."""
    return vocabulary.groupBy("route").agg(F.count("*").alias("n_features"))


def row_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))
