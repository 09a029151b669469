"""Named queries over the driver's tables: each operator on whole tables, as ``f(spark, sf_dir)``."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from credence.functions import text as X
from credence.functions.stopwords import ENGLISH
from credence.operators import evaluate as E
from credence.operators import features, logistic, models
from credence.operators import normalize as N
from credence.operators.annotate import spans
from credence.operators.lookup import lookup
from credence.operators.ranking import sorted_numbers
from credence.operators.split import stratified_split, stratum_quotas
from credence.plans import registry, report, run
from credence.plans import train as T
from credence.schema import ARTICLE, ARTICLE_CSV_COLUMNS, CLAIM_TSV_COLUMNS, META_FIELDS, PREDICTION, RECORD
from credence.session import SETTINGS, stage_path
from credence.sources import compact, files, latest, tables, topic
from credence.streaming import jobs, state

T_ARCHIVE = StructType([*PREDICTION.fields, StructField("dt", DateType()), StructField("batch", LongType())])
FILES = 4               # of one micro-batch
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NB, SMOOTH = T.NB, "naive_bayes_smooth"
BOTH_ALPHAS = {NB: T.fit_naive_bayes, SMOOTH: lambda f: T.fit_naive_bayes(f, alpha=1.0)}


def query(f: Query) -> Query:
    def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        return f(spark, sf_dir)
    QUERIES[f.__name__] = with_settings
    return f


def bigint(c: Column) -> Column:
    return c.cast("bigint")


def timestamp_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def naive_bayes(spark: SparkSession, sf_dir: str, fits: dict | None = None) -> T.Trained:
    return T.train(tables.labelled_articles(spark, sf_dir), fits or {NB: T.fit_naive_bayes},
                   route_of_source=tables.TABLE_ROUTES)


def fit_nb(spark: SparkSession, sf_dir: str) -> models.CredibilityModel:
    """Naive Bayes fitted on the training rows; nothing is evaluated."""
    fitted = T.fit_features(tables.labelled_articles(spark, sf_dir), tables.TABLE_ROUTES)
    return T.fit_models(fitted, {NB: T.fit_naive_bayes}, "table")[1][NB]


def training_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, route by source, input) of all labelled rows."""
    rows = T.prepare_training(tables.labelled_articles(spark, sf_dir), tables.TABLE_ROUTES)
    return rows.select("id", F.col("fit_route").alias("route"), T.input_for(F.col("fit_route")).alias("input"))


# ----------------------------------------------------------------------------- normalising

@query
def normalize_documents(spark, sf_dir):
    return tables.labelled_articles(spark, sf_dir, labelled_only=False).select(
        "id", "source", "title", "text", "speaker", "subject", "label", "label_raw")


@query
def normalize_conversations(spark, sf_dir):
    return tables.conversations(spark, sf_dir).select("id", "source", "title", "text", "speaker", "party")


@query
def union_all_sources(spark, sf_dir):
    return tables.all_sources(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n"), bigint(F.sum(F.length("text"))).alias("chars"), F.count("label").alias("labelled"))


@query
def distinct_sources(spark, sf_dir):
    return tables.all_sources(spark, sf_dir).select("source").distinct().orderBy("source")


@query
def grade_binarize(spark, sf_dir):
    grades = {"view": "TRUE", "click": " mostly-true", "error": "pants-fire", "signup": " False ", "purchase": "unknown"}
    e = tables.table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.create_map(*[F.lit(x) for kv in grades.items() for x in kv]), F.col("event_type")).alias("grade"))
    return e.select("event_id", "grade", N.grade_label("grade").alias("label"))


@query
def label_cast(spark, sf_dir):
    """Float text labels are truncated; blank ones are null; only 0 and 1 are kept."""
    raw = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    e = tables.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", N.binary_label("raw").alias("label")).where(F.col("label").isin(0, 1))


@query
def record_validation(spark, sf_dir):
    checked = N.with_defaults(tables.all_sources(spark, sf_dir)).withColumn("violations", N.violations())
    return checked.groupBy("source", F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@query
def dedup_keep_last(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), "turn", "role", "text")
    return N.keep_last(rows, ["turn"])


def _interleave(spark, sf_dir, limit):
    parts = [("page", "pages", "page_id"), ("benchmark", "benchmark", "item_id"), ("document", "documents", "doc_id")]
    rows = N.union_all(*[
        tables.table(spark, sf_dir, t).select(
            F.concat(F.lit(f"{s}-"), F.col(k).cast("string")).alias("id"), F.lit(s).alias("source"), F.col(k).alias("seq"))
        for s, t, k in parts])
    return N.interleave(rows, "seq", [s for s, _, _ in parts], limit).select("id", "source", "turn", "source_rank")


@query
def interleave_sources(spark, sf_dir):
    return _interleave(spark, sf_dir, 0)


@query
def interleave_limit(spark, sf_dir):
    return _interleave(spark, sf_dir, 150)


@query
def source_selection(spark, sf_dir):
    """Articles and claims written as raw data sets, loaded by names with blanks, and counted as sent."""
    root = stage_path(spark, "raw-sets")
    _write_articles(spark, sf_dir, f"{root}/kaggle/train.csv")
    _write_claims(spark, sf_dir, f"{root}/liar/valid.tsv")
    names = files.source_names(["liar ", " kaggle"])
    return topic.sent_counts(files.load_raw(spark, root, names)).unionByName(
        topic.sent_counts(files.load_raw(spark, root, [" liar"])).withColumn("source", F.lit("liar alone")))


# ----------------------------------------------------------------------------- text

@query
def clean_documents(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", X.clean_text("text").alias("cleaned"))


@query
def clean_pages(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("id", X.strip("title").alias("title"), X.model_input("title", "text").alias("input"))


@query
def meta_tokens_conversations(spark, sf_dir):
    rows = N.with_defaults(tables.conversations(spark, sf_dir)).withColumn(
        "context", F.concat_ws(", ", F.lit("Turn"), "id"))
    return rows.select("id", X.meta_tokens().alias("tokens"), X.has_meta().alias("has_meta"))


@query
def word_counts(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", bigint(X.word_count("text")).alias("words"))


@query
def prepared_inputs(spark, sf_dir):
    rows = N.with_defaults(tables.all_sources(spark, sf_dir)).withColumn("route", X.route_for())
    return rows.select("id", "route", X.prepare("route").alias("input"))


@query
def prepared_inputs_capped(spark, sf_dir):
    """The option that cuts cleaned texts, here after 10,000 characters."""
    rows = N.with_defaults(tables.all_sources(spark, sf_dir)).withColumn("route", X.route_for())
    return rows.select("id", "route", X.prepare("route", max_chars=10_000).alias("input"))


@query
def route_counts(spark, sf_dir):
    rows = N.with_defaults(tables.all_sources(spark, sf_dir))
    return rows.groupBy("source", X.route_for().alias("route")).agg(F.count("*").alias("n"))


@query
def routing_accuracy(spark, sf_dir):
    expected = {**tables.TABLE_ROUTES, "page": "article", "conversation": "claim", "benchmark": "claim"}
    rows = N.with_defaults(tables.all_sources(spark, sf_dir)).select(
        F.lit("rule").alias("model"), "source", X.route_for().alias("route"))
    return E.routing_accuracy(rows, expected)


# ----------------------------------------------------------------------------- features

@query
def token_stats(spark, sf_dir):
    docs = training_docs(spark, sf_dir).select("id", X.term_counts("input", ENGLISH).alias("t"))
    return docs.select("id", bigint(F.size("t")).alias("terms"),
                       bigint(F.aggregate("t", F.lit(0), lambda a, x: a + x["tf"])).alias("occurrences"))


@query
def doc_frequency(spark, sf_dir):
    return features.document_frequency(training_docs(spark, sf_dir)).select(
        "route", "term", "df", bigint(F.col("cf")).alias("cf"))


@query
def vocabulary(spark, sf_dir):
    return features.fit_vocabulary(training_docs(spark, sf_dir)).select(
        "route", "term", bigint(F.col("idx")).alias("idx"), "df", bigint(F.col("cf")).alias("cf"), F.round("idf", 6).alias("idf"))


@query
def vocabulary_topk(spark, sf_dir):
    return features.fit_vocabulary(training_docs(spark, sf_dir), max_features=500).select(
        "route", "term", "df", bigint(F.col("cf")).alias("cf"))


@query
def features_by_route(spark, sf_dir):
    return T.feature_counts(features.fit_vocabulary(training_docs(spark, sf_dir)))


@query
def tfidf_documents(spark, sf_dir):
    docs = training_docs(spark, sf_dir)
    return features.tfidf(docs, features.fit_vocabulary(docs)).select(
        "id", "route", "term", bigint(F.col("tf")).alias("tf"), F.round("tfidf", 6).alias("tfidf"))


@query
def tfidf_head_tail(spark, sf_dir):
    """The same through a lookup that broadcasts frequent terms only: the rest passes the filter and is joined by id."""
    docs = training_docs(spark, sf_dir)
    table = features.fit_vocabulary(docs).select("route", "term", "idf")
    return features.tfidf(docs, lookup(table, limit=0, head_bytes=200_000)).select(
        "id", "route", "term", bigint(F.col("tf")).alias("tf"), F.round("tfidf", 6).alias("tfidf"))


# ----------------------------------------------------------------------------- split and weights

def _split(spark, sf_dir):
    return stratified_split(tables.labelled_articles(spark, sf_dir).select("id", "source", "label"))


@query
def split_quotas(spark, sf_dir):
    counts = tables.labelled_articles(spark, sf_dir).groupBy("source", "label").agg(F.count("*").alias("n"))
    return stratum_quotas(counts, ["source", "label"]).select("source", "label", "n", "quota")


@query
def stratified_split_rows(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "source", "label", "is_test")


@query
def split_counts(spark, sf_dir):
    return T.row_counts(_split(spark, sf_dir), ["source", "label", "is_test"])


@query
def class_weights(spark, sf_dir):
    rows = _split(spark, sf_dir).where(~F.col("is_test")).withColumn("route", T.source_route(tables.TABLE_ROUTES))
    return models.class_weights(models.class_counts(rows)).withColumn("weight", F.round("weight", 6))


# ----------------------------------------------------------------------------- naive Bayes

@query
def nb_weights(spark, sf_dir):
    return fit_nb(spark, sf_dir).terms.select("route", "term", F.round("weight", 6).alias("weight"))


@query
def nb_weights_top(spark, sf_dir):
    m = fit_nb(spark, sf_dir)
    return models.global_top_terms(m.terms, m.routes)


@query
def nb_predict(spark, sf_dir):
    return naive_bayes(spark, sf_dir).predictions.select("id", "source", "label", "route", F.round("p", 6).alias("p"))


def _scores(spark, sf_dir):
    return naive_bayes(spark, sf_dir).metrics().drop("model")


@query
def nb_metrics_overall(spark, sf_dir):
    return _scores(spark, sf_dir).where(F.col("scope") == E.OVERALL)


@query
def nb_metrics_by_source(spark, sf_dir):
    return _scores(spark, sf_dir).where(F.col("scope") != E.OVERALL)


@query
def nb_routing_accuracy(spark, sf_dir):
    return T.routing(naive_bayes(spark, sf_dir), tables.TABLE_ROUTES).select("routing_accuracy")


@query
def confusion_matrix(spark, sf_dir):
    return report.confusion_shares(E.confusion(naive_bayes(spark, sf_dir).predictions)).select(
        "scope", "actual", "predicted", "n", F.round("share", 6).alias("share"))


@query
def roc_auc(spark, sf_dir):
    return E.roc_auc(naive_bayes(spark, sf_dir).predictions).select("scope", F.round("roc_auc", 6).alias("roc_auc"))


@query
def roc_auc_events(spark, sf_dir):
    """AUC over a large table with many tied scores: does a high value tell errors from other events?"""
    rows = tables.table(spark, sf_dir, "events").select(
        F.lit("value").alias("model"), F.concat(F.lit("user-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("source"),
        (F.col("event_type") == "error").cast("int").alias("label"), F.round("value", 0).alias("p"))
    return E.roc_auc(rows).select("scope", F.round("roc_auc", 6).alias("roc_auc"))


@query
def model_compare(spark, sf_dir):
    return report.comparison(naive_bayes(spark, sf_dir, BOTH_ALPHAS).metrics(), [NB, SMOOTH])


@query
def kpi_delta(spark, sf_dir):
    return report.kpi_delta(naive_bayes(spark, sf_dir, BOTH_ALPHAS).metrics(), NB, SMOOTH)


@query
def best_model(spark, sf_dir):
    return E.best_model(naive_bayes(spark, sf_dir, BOTH_ALPHAS).metrics(), [NB, SMOOTH]).select("model", "macro_f1")


@query
def source_table(spark, sf_dir):
    return report.source_table(naive_bayes(spark, sf_dir).metrics(), NB)


# ----------------------------------------------------------------------------- scoring

def _scored(spark, sf_dir):
    return models.score(tables.all_sources(spark, sf_dir), fit_nb(spark, sf_dir))


@query
def score_batch(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "id", "title", "snippet", "source", "label", "label_id", "route", F.round("confidence", 4).alias("confidence"),
        F.col("probabilities")["reliable"].alias("p_reliable"), F.col("probabilities")["unreliable"].alias("p_unreliable"))


def _explained(spark, sf_dir):
    return models.explode_explanations(_scored(spark, sf_dir))


@query
def nb_explain_topk(spark, sf_dir):
    return _explained(spark, sf_dir).select("id", "route", bigint(F.col("rank")).alias("rank"), "term", "weight", "direction")


@query
def term_strength(spark, sf_dir):
    return _explained(spark, sf_dir).select("id", "term", F.round("strength", 9).alias("strength"))


@query
def feed_terms(spark, sf_dir):
    shown = report.feed_terms(_scored(spark, sf_dir))
    return shown.select("id", "label", F.posexplode("feed_terms").alias("rank", "term")).withColumn("rank", bigint(F.col("rank")))


@query
def verdict_terms(spark, sf_dir):
    """Both sides of a verdict as shown to a reader: six terms each, with strengths."""
    shown = report.side_terms(_scored(spark, sf_dir))
    return shown.select("id", "side", bigint(F.col("rank")).alias("rank"), "term", "weight", F.round("strength", 9).alias("strength"))


@query
def score_position(spark, sf_dir):
    """Scored rows put back in input order by their position."""
    rows = tables.benchmark(spark, sf_dir).orderBy("id")
    scored = models.score(rows, fit_nb(spark, sf_dir), position="at").select("id", "label", "at")
    return sorted_numbers(scored, [], ["at"], "place", "bigint").select("id", "label", (F.col("place") + 1).alias("place"))


@query
def fallback_route(spark, sf_dir):
    """A model without a sub-model for articles: every row goes to the one that there is."""
    claims = tables.labelled_articles(spark, sf_dir).where(F.col("source") == "claim")
    fitted = T.fit_features(claims, tables.TABLE_ROUTES)
    model = T.fit_models(fitted, {NB: T.fit_naive_bayes}, "claims-only")[1][NB]
    return models.score(tables.all_sources(spark, sf_dir), model).select("id", "route", F.round("confidence", 4).alias("confidence"), "label")


@query
def registry_fallback(spark, sf_dir):
    """Of three registries the first has no model and the second points to tables that are gone: the third one's scores."""
    root = stage_path(spark, "registries")
    model = fit_nb(spark, sf_dir)
    for base in ("second", "third"):
        registry.publish(model, f"{root}/{base}", {})
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/second/v{model.version}")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    found = registry.load_latest(spark, *[f"{root}/{base}" for base in ("first", "second", "third")])
    scored = models.score(tables.benchmark(spark, sf_dir), found)
    return scored.select("id", "label", F.round("confidence", 4).alias("confidence"), F.lit(found.origin.split("/")[-2]).alias("registry"))


@query
def pretty_terms(spark, sf_dir):
    return fit_nb(spark, sf_dir).terms.where("term RLIKE '(^| )(spk|subj)_'").select("term", X.pretty_term("term").alias("shown"))


@query
def annotate_spans(spark, sf_dir):
    scored = models.score(tables.labelled_articles(spark, sf_dir), fit_nb(spark, sf_dir), passthrough=["text"])
    marked = scored.select("id", F.posexplode(spans("text", "top_terms")).alias("n", "s"))
    return marked.select("id", bigint(F.col("n")).alias("n"), bigint(F.col("s.start")).alias("start"), bigint(F.col("s.end")).alias("end"),
                         "s.term", "s.direction", "s.weight", "s.alpha")


# ----------------------------------------------------------------------------- logistic regression

def _dense_events(spark, sf_dir):
    """Events as dense vectors of two features, and whether they are errors."""
    values = F.array(F.col("value") / 100, F.pmod("user_id", F.lit(7)) / 7)
    return tables.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (F.col("event_type") == "error").cast("int").alias("label"), F.lit("article").alias("route"),
        F.array(F.lit(0), F.lit(1)).alias("indices"), values.alias("values"))


def _dense_fit(spark, sf_dir):
    vectors = _dense_events(spark, sf_dir)
    counts = models.class_counts(vectors).first()
    weights, intercept, _ = logistic.fit(vectors, {"article": 2}, {"article": (counts["n0"], counts["n1"])}, {"article": 0.5}, 100, 1e-13)
    two = {r["idx"]: r["weight"] for r in weights.collect()}
    return vectors, [two[0], two[1], intercept["article"]]


@query
def lr_dense_weights(spark, sf_dir):
    """Logistic regression at its optimum: balanced classes, penalised weights and intercept."""
    _, fitted = _dense_fit(spark, sf_dir)
    events = tables.table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return events.select("n", *[F.round(F.lit(w), 4).alias(name) for name, w in zip(("w0", "w1", "intercept"), fitted)])


@query
def lr_dense_predict(spark, sf_dir):
    vectors, (w0, w1, b) = _dense_fit(spark, sf_dir)
    z = F.lit(b) + F.lit(w0) * F.get("values", F.lit(0)) + F.lit(w1) * F.get("values", F.lit(1))
    return vectors.select("id", "label", F.round(models.logistic(z), 3).alias("p"))


def _logistic(spark, sf_dir):
    return T.train(tables.labelled_articles(spark, sf_dir), route_of_source=tables.TABLE_ROUTES)


@query
def lr_predict(spark, sf_dir):
    t = T.train(tables.labelled_articles(spark, sf_dir), {T.LR: T.fit_logistic}, route_of_source=tables.TABLE_ROUTES)
    return t.predictions.select("id", "source", "label", "route", F.round("p", 4).alias("p"))


def _gentle(spark, sf_dir):
    """Both routes on their whole vocabularies, so strongly regularised that SQL reaches the optimum by plain gradient steps."""
    return T.train(tables.labelled_articles(spark, sf_dir), {T.LR: lambda f: T.fit_logistic(f, c={"article": 0.002, "claim": 0.001}, tol=0.0)},
                   route_of_source=tables.TABLE_ROUTES)


@query
def lr_text_predict(spark, sf_dir):
    return _gentle(spark, sf_dir).predictions.select("id", "source", "label", "route", F.round("p", 4).alias("p"))


@query
def lr_text_weights(spark, sf_dir):
    """Intercept, number, sum, length and extremes of every route's coefficients."""
    model = _gentle(spark, sf_dir).models[T.LR]
    w = F.col("weight")
    return model.terms.groupBy("route").agg(
        F.count("*").alias("n"), F.round(F.sum(w), 4).alias("total"), F.round(F.sqrt(F.sum(w * w)), 4).alias("length"),
        F.round(F.max(w), 4).alias("greatest"), F.round(F.min(w), 4).alias("least")).withColumn(
        "intercept", F.round(models.by_route(model.bias), 4))


@query
def lr_metrics(spark, sf_dir):
    return _logistic(spark, sf_dir).metrics()


@query
def metrics_document(spark, sf_dir):
    """Train both classifiers, publish the better one, load it back: its nested metrics as JSON."""
    t = _logistic(spark, sf_dir)
    document = registry.metrics_document(t, f"tables:{sf_dir}", tables.TABLE_ROUTES)
    base = stage_path(spark, "models")
    registry.publish(t.models[document["best_model"]], base, document)
    return spark.read.text(f"{base}/v{t.version}/metrics", wholetext=True)


@query
def metrics_document_scores(spark, sf_dir):
    """The published metrics document of a naive Bayes run, read back, as flat scores; with the version of its time."""
    t = T.train(tables.labelled_articles(spark, sf_dir), {NB: T.fit_naive_bayes}, datetime(2024, 5, 6, 7, 8, 9), route_of_source=tables.TABLE_ROUTES)
    base = stage_path(spark, "models")
    registry.publish(t.models[NB], base, registry.metrics_document(t, f"tables:{sf_dir}", tables.TABLE_ROUTES))
    document = registry.load_latest(spark, base).metrics
    rows = registry.metrics_table(spark, document).select("version", "model", "scope", "metric", "value")
    counts = [(k, float(document[k])) for k in ("n_train", "n_test", "n_features")]
    top = spark.createDataFrame(counts, "metric string, value double").select(
        F.lit(document["version"]).alias("version"), F.lit(document["best_model"]).alias("model"), F.lit("run").alias("scope"), "metric", "value")
    return rows.unionByName(top)


# ----------------------------------------------------------------------------- live feed

def _now(spark, sf_dir):
    return tables.feed(spark, sf_dir).agg(F.max("scored_at")).scalar().cast("timestamp")


@query
def recent_feed(spark, sf_dir):
    return report.recent(tables.feed(spark, sf_dir)).select(
        "id", timestamp_text("scored_at").alias("scored_at"), "label", "confidence")


@query
def feed_stats(spark, sf_dir):
    return report.feed_stats(tables.feed(spark, sf_dir)).select(
        "n", F.round("unreliable_share", 6).alias("unreliable_share"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query
def throughput_buckets(spark, sf_dir):
    return report.throughput(tables.feed(spark, sf_dir), _now(spark, sf_dir), seconds=3600)


@query
def feed_throughput(spark, sf_dir):
    return report.throughput(tables.feed(spark, sf_dir), _now(spark, sf_dir))


@query
def feed_freshness(spark, sf_dir):
    """The feed half a minute, a minute and an hour after its newest verdict, and without its live events."""
    feed, parts = tables.feed(spark, sf_dir), []
    for seconds in (30, 60, 3600):
        now = _now(spark, sf_dir) + F.expr(f"INTERVAL {seconds} SECONDS")
        for name, rows in (("all", feed), ("unreliable", feed.where("label = 'unreliable'"))):
            parts.append(report.freshness(rows, now).select(F.lit(name).alias("rows"), F.lit(seconds).alias("seconds"), timestamp_text("newest").alias("newest"), "is_live"))
    return N.union_all(*parts)


@query
def windowed_flag_rate(spark, sf_dir):
    return report.window_rates(tables.feed(spark, sf_dir)).select(
        timestamp_text("window_start").alias("window_start"), "n", "flagged", F.round("flag_rate", 6).alias("flag_rate"),
        F.round("mean_confidence", 6).alias("mean_confidence"))


@query
def lineage(spark, sf_dir):
    return report.lineage(tables.labelled_articles(spark, sf_dir), "raw").select("source", "n", "path", "selection_metric")


# ----------------------------------------------------------------------------- sources, sinks, streams

@query
def article_csv_scan(spark, sf_dir):
    """Labelled documents written as the article CSV (texts hold newlines), scanned and normalised."""
    root = stage_path(spark, "csv")
    _write_articles(spark, sf_dir, root)
    return N.normalize_articles(files.read_article_csv(spark, root)).select(
        "id", "source", "title", "author", "text", "label", "label_raw")


@query
def csv_header_check(spark, sf_dir):
    """Labelled documents as article CSV with the expected header, with two columns swapped, and with one missing: rows read, or an error."""
    root = stage_path(spark, "headers")
    for name, columns in (("expected", ARTICLE_CSV_COLUMNS), ("swapped", [*ARTICLE_CSV_COLUMNS[1::-1], *ARTICLE_CSV_COLUMNS[2:]]), ("missing", ARTICLE_CSV_COLUMNS[:-1])):
        _write_articles(spark, sf_dir, f"{root}/{name}", columns)
    def read(name):
        try:
            return name, files.read_article_csv(spark, f"{root}/{name}").agg(F.count("*").alias("n")).first()["n"], False
        except PySparkException as e:
            return name, None, "header" in str(e)
    return spark.createDataFrame([read(n) for n in ("expected", "swapped", "missing")], "header string, n long, refused boolean")


@query
def ingestion_time(spark, sf_dir):
    """Records get the time at which they are normalised."""
    start = F.current_timestamp() - F.expr("INTERVAL 1 HOUR")
    root = stage_path(spark, "times")
    _write_articles(spark, sf_dir, f"{root}/csv")
    _write_claims(spark, sf_dir, f"{root}/tsv")
    rows = N.union_all(N.normalize_articles(files.read_article_csv(spark, f"{root}/csv")), N.normalize_claims(files.read_claim_tsv(spark, f"{root}/tsv", "train")))
    return rows.select("id", "source", F.col("ingested_at").between(start, F.current_timestamp()).alias("now"))


def _write_articles(spark, sf_dir, root, columns=ARTICLE_CSV_COLUMNS):
    docs = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('The "'), "source", F.lit('", daily')).alias("title"),
        F.when(F.col("lang") == "en", "None").otherwise(F.col("lang")).alias("author"), "text",
        F.concat((1 - F.col("quality")).cast("string"), F.lit(".0")).alias("label"))
    docs.select(*columns).write.csv(root, header=True, quote='"', escape='"', quoteAll=True)


@query
def claim_tsv_scan(spark, sf_dir):
    """Conversations written as the 14-column TSV (tabs and newlines blanked), scanned and normalised."""
    root = stage_path(spark, "tsv")
    _write_claims(spark, sf_dir, root)
    return N.normalize_claims(files.read_claim_tsv(spark, root, "train")).select(
        "id", "source", "text", "speaker", "party", "label", "label_raw")


def _write_claims(spark, sf_dir, root):
    cells = {"json_id": F.concat_ws("-", "conv_id", "turn"),
             "label": F.when(F.col("role") == "user", "half-true").when(F.col("role") == "assistant", " False"),
             "statement": F.regexp_replace("text", "[\\t\\r\\n]+", " "), "speaker": F.col("role"), "party": F.lit("None")}
    line = [F.coalesce(cells.get(c, F.lit("")), F.lit("")) for c in CLAIM_TSV_COLUMNS]
    extra = F.when(F.pmod("turn", F.lit(5)) == 4, F.lit("\ttoo\tlong")).otherwise("")
    tables.table(spark, sf_dir, "conversations").select(F.concat(F.concat_ws("\t", *line), extra).alias("value")).write.text(root)


@query
def json_lines_scan(spark, sf_dir):
    """All sources landed as date-partitioned JSON lines and scanned back."""
    root = stage_path(spark, "landed")
    files.write_landed(tables.all_sources(spark, sf_dir), root)
    return files.read_landed(spark, root).select(
        "id", "source", "title", "text", "speaker", "label", F.datediff(F.current_date(), "dt").between(0, 1).alias("dated"))


@query
def json_records(spark, sf_dir):
    """Keyed JSON records and back."""
    rows = topic.to_records(tables.conversations(spark, sf_dir))
    return rows.select("key", F.from_json("value", ARTICLE).alias("r")).select(
        "key", "r.source", "r.text", "r.speaker")




@query
def live_ingest(spark, sf_dir):
    """Submitted articles as live records: well-formed fresh id, source 'live', blank metadata left out."""
    rows = topic.live_records(tables.conversations(spark, sf_dir))
    return rows.select(F.col("id").rlike("^live-[0-9a-f]{12}$").alias("id_ok"), "source", "title", "text", *META_FIELDS)


@query
def stream_land(spark, sf_dir):
    """Topic of all sources -> landing stream until idle -> scan of the landed files, last record per id."""
    root = stage_path(spark, "stream")
    first = tables.all_sources(spark, sf_dir).withColumn("seq", F.lit(1))
    again = tables.conversations(spark, sf_dir).withColumn("speaker", F.lit("corrected")).withColumn("seq", F.lit(2))
    topic.write_records(N.union_all(again, first), topic.TOPIC_ARTICLES, "parquet", root)
    stream = topic.read_topic(spark, topic.TOPIC_ARTICLES, RECORD, format="parquet", path=root)
    jobs.land(stream, f"{root}/raw", f"{root}/checkpoint", until_idle=True).awaitTermination()
    return run.latest_articles(files.read_landed(spark, f"{root}/raw")).select("id", "source", "title", "text", "speaker")


@query
def landed_compaction(spark, sf_dir):
    """A day of many landed files, compacted twice while the sink goes on: the records and files that a reader takes
    before, between, after, and from what was opened before the first compaction."""
    root = stage_path(spark, "compaction")
    source = tables.all_sources(spark, sf_dir).withColumn("seq", F.lit(1))
    topic.write_records(source.coalesce(12), topic.TOPIC_ARTICLES, "parquet", root)
    stream = topic.read_topic(spark, topic.TOPIC_ARTICLES, RECORD, format="parquet", path=root, limit=4)

    def land():
        jobs.land(stream, f"{root}/raw", f"{root}/checkpoint", until_idle=True).awaitTermination()

    def seen(step, rows):
        return rows.groupBy("source").agg(F.count("*").alias("n"), bigint(F.sum(F.length("text"))).alias("chars")).select(F.lit(step).alias("step"), "source", "n", "chars")
    land()
    opened = compact.read_live(spark, f"{root}/raw")
    parts, days = [seen("landed", opened)], sorted({str(r["dt"]) for r in opened.select("dt").distinct().collect()})
    for day in days:
        compact.compact(spark, f"{root}/raw", day)
    parts.append(seen("compacted", compact.read_live(spark, f"{root}/raw")))
    topic.write_records(source.coalesce(5), topic.TOPIC_ARTICLES, "parquet", root)
    land()
    parts.append(seen("landed again", compact.read_live(spark, f"{root}/raw")))
    for day in sorted({str(r["dt"]) for r in files.read_landed(spark, f"{root}/raw").select("dt").distinct().collect()}):
        compact.compact(spark, f"{root}/raw", day)
    last = compact.read_live(spark, f"{root}/raw")
    if scattered := compact.scattered_days(spark, last.inputFiles()):
        raise AssertionError(f"compacted days are still many files: {scattered}")
    return N.union_all(*parts, seen("compacted again", last), seen("opened first", opened))


@query
def landed_latest(spark, sf_dir):
    """Three landings, each merged into the table of last records: it equals the last records of everything that landed."""
    root = stage_path(spark, "latest")
    every = tables.all_sources(spark, sf_dir).withColumn("seq", F.lit(1))
    corrected = [tables.conversations(spark, sf_dir).withColumn("speaker", F.lit("corrected")).withColumn("seq", F.lit(2)),
                 tables.benchmark(spark, sf_dir).withColumn("speaker", F.lit("checked")).withColumn("seq", F.lit(3))]
    for rows in (every, *corrected):
        topic.write_records(rows, topic.TOPIC_ARTICLES, "parquet", root)
        stream = topic.read_topic(spark, topic.TOPIC_ARTICLES, RECORD, format="parquet", path=root)
        jobs.land(stream, f"{root}/raw", f"{root}/checkpoint", until_idle=True).awaitTermination()
        latest.merge_landed(spark, f"{root}/raw", f"{root}/table", buckets=16)
    return latest.read_latest(spark, f"{root}/table").select("id", "source", "title", "text", "speaker")


@query
def raw_last_record(spark, sf_dir):
    """Article CSV files that repeat ids, loaded for training: the last record of an id by file and position.

    The rows are sorted over all files: a conversation may begin in one file and end in the next.
    """
    root = stage_path(spark, "repeats")
    rows = tables.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select(
        F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("turn "), "turn").alias("title"), F.col("role").alias("author"),
        F.lit("zzz, the same text").alias("text"), F.lit("1").alias("label"))
    rows.write.csv(f"{root}/kaggle/train.csv", header=True, quote='"', escape='"', quoteAll=True)
    return run.latest_raw(spark, root).select("id", "source", "title", "author", "text", "label")


@query
def stream_score(spark, sf_dir):
    """Incoming topic -> scoring stream with a published model -> archive of predictions."""
    root = stage_path(spark, "scoring")
    registry.publish(fit_nb(spark, sf_dir), f"{root}/models", {})
    incoming = N.union_all(tables.conversations(spark, sf_dir), tables.benchmark(spark, sf_dir))
    topic.write_records(incoming, topic.TOPIC_INCOMING, "parquet", root)
    stream = topic.read_topic(spark, topic.TOPIC_INCOMING, format="parquet", path=root, starting="latest")
    jobs.score_stream(
        stream, [f"{root}/models"], f"{root}/archive", f"{root}/checkpoint",
        publish=lambda p: topic.write_records(p, topic.TOPIC_PREDICTIONS, "parquet", root), until_idle=True,
    ).awaitTermination()
    archived = spark.read.schema(T_ARCHIVE).json(f"{root}/archive")
    return archived.select("id", "source", "label", "route", "confidence", (F.col("dt") == F.to_date("scored_at")).alias("dated"),
                           bigint(F.col("batch")).alias("batch"))


@query
def stream_publish_once(spark, sf_dir):
    """A scoring job that stops three times: before, half way through and after publishing. Every prediction is sent once."""
    root = stage_path(spark, "once")
    registry.publish(fit_nb(spark, sf_dir), f"{root}/models", {})
    topic.write_records(tables.benchmark(spark, sf_dir).repartition(FILES), topic.TOPIC_INCOMING, "parquet", root)
    stops = ["before", "half", "after", None]

    def publish(predictions):
        stop = stops.pop(0)
        half = predictions.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0) if stop == "half" else predictions
        if stop != "before":
            topic.write_records(half, topic.TOPIC_PREDICTIONS, "parquet", root)
        if stop:
            raise RuntimeError(f"stopped {stop} publishing")

    while stops:
        stream = topic.read_topic(spark, topic.TOPIC_INCOMING, format="parquet", path=root)
        try:
            jobs.score_stream(stream, [f"{root}/models"], f"{root}/archive", f"{root}/checkpoint", publish, until_idle=True,
                              delivered=lambda n, since: topic.delivered(spark, topic.TOPIC_PREDICTIONS, n, since, "parquet", root)).awaitTermination()
        except StreamingQueryException as e:
            if "stopped" not in str(e):
                raise
    sent = topic.from_records(spark.read.schema(topic.RECORD).parquet(f"{root}/{topic.TOPIC_PREDICTIONS}"), PREDICTION)
    return sent.groupBy("id", "label", F.round("confidence", 4).alias("confidence")).agg(F.count("*").alias("sent"))


@query
def stream_reload(spark, sf_dir):
    """Three throttled micro-batches; after each one another version is published, which the next one uses."""
    root = stage_path(spark, "reload")
    models_ = T.fit_models(T.fit_features(tables.labelled_articles(spark, sf_dir), tables.TABLE_ROUTES), BOTH_ALPHAS, "v0")[1]
    turns = [models_[NB], models_[SMOOTH]]

    def publish(number: int) -> None:
        model = turns[number % 2]
        model.version = f"v{number}"
        registry.publish(model, f"{root}/models", {})

    publish(0)
    for rows in (tables.benchmark(spark, sf_dir), tables.conversations(spark, sf_dir), tables.benchmark(spark, sf_dir)):
        topic.write_records(rows.repartition(FILES), topic.TOPIC_INCOMING, "parquet", root)
        time.sleep(0.1)             # files are taken by age
    stream = topic.read_topic(spark, topic.TOPIC_INCOMING, format="parquet", path=root, limit=FILES)
    done = []
    jobs.score_stream(stream, [f"{root}/models"], f"{root}/archive", f"{root}/checkpoint", until_idle=True,
                      publish=lambda p: (done.append(1), publish(len(done)))).awaitTermination()
    return spark.read.schema(T_ARCHIVE).json(f"{root}/archive").select(
        "id", "label", "confidence", "model", "model_version", bigint(F.col("batch")).alias("batch"))


@query
def stream_repeats(spark, sf_dir):
    """The feed delivered twice, the second time within the watermark's delay: every verdict once."""
    root = stage_path(spark, "repeats")
    feed = tables.feed(spark, sf_dir).withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    late = feed.withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 10 MINUTES"))
    feed.union(late).write.parquet(f"{root}/feed")
    stream = spark.readStream.schema("id string, scored_at timestamp, label string, confidence double").parquet(f"{root}/feed")
    (jobs.drop_repeats(stream, "scored_at").writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(feed.schema).parquet(f"{root}/out").select("id", "label", "confidence")


ARRIVED = "id string, scored_at timestamp, label string, confidence double, arrival long"


def _arriving(spark, sf_dir):
    """The feed with arrival numbers that have nothing to do with its times."""
    feed = tables.feed(spark, sf_dir)
    return feed.withColumn("scored_at", F.col("scored_at").cast("timestamp")).withColumn(
        "arrival", F.pmod(F.col("id").cast("long") * 7919, F.lit(2147483647))).select("id", "scored_at", "label", "confidence", "arrival")


@query
def stream_last_arrivals(spark, sf_dir):
    """Verdicts that arrive out of time order, in three micro-batches: the 300 that arrived last."""
    root = stage_path(spark, "arrivals")
    feed = _arriving(spark, sf_dir)
    for part in range(3):
        feed.where(F.pmod("arrival", F.lit(3)) == part).repartition(FILES).write.mode("append").parquet(f"{root}/feed")
        time.sleep(0.1)
    stream = spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", FILES).parquet(f"{root}/feed")
    state.write_last_arrivals(state.last_arrivals(stream, "arrival"), f"{root}/last", f"{root}/checkpoint", until_idle=True).awaitTermination()
    return state.read_last_arrivals(spark, f"{root}/last", "arrival").select("id", "label", "confidence", "arrival")


@query
def stream_minute_counts(spark, sf_dir):
    """The feed in three micro-batches, without what falls into every fifth hour: at the end of each hour that the
    watermark has passed, the verdicts of the fifteen hours before it, empty ones included."""
    root = stage_path(spark, "minutes")
    feed = _arriving(spark, sf_dir).withColumn("hour", F.floor(F.col("scored_at").cast("double") / 3600)).where("pmod(hour, 5) <> 0")
    span = feed.agg(F.min("hour").alias("first"), F.max("hour").alias("last")).first()
    third = F.floor(3 * (F.col("hour") - span["first"]) / (span["last"] - span["first"] + 1))
    for part in range(3):
        feed.where(third == part).drop("hour").repartition(FILES).write.mode("append").parquet(f"{root}/feed")
        time.sleep(0.1)
    stream = spark.readStream.schema(ARRIVED).option("maxFilesPerTrigger", FILES).parquet(f"{root}/feed")
    counts = state.minute_counts(stream, seconds=3600, delay="0 seconds")
    with state.state_store(spark):
        started = (counts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/counts")
                   .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    started.awaitTermination()
    total = state.total_counts(spark.read.schema(state.COUNTS).parquet(f"{root}/counts"))
    return total.select(timestamp_text("now").alias("now"), bigint(F.col("bucket")).alias("bucket"), "n")


@query
def stream_flag_rate(spark, sf_dir):
    """The feed as a stream with a watermark: verdicts and flag rate of the closed windows."""
    root = stage_path(spark, "rates")
    tables.feed(spark, sf_dir).withColumn("scored_at", F.col("scored_at").cast("timestamp")).write.parquet(f"{root}/feed")
    feed = spark.readStream.schema("id string, scored_at timestamp, label string, confidence double").parquet(f"{root}/feed")
    (jobs.rate_stream(feed, minutes=60).writeStream.format("parquet").option("path", f"{root}/out")
     .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{root}/out").select(
        timestamp_text("window_start").alias("window_start"), "n", "flagged", F.round("flag_rate", 6).alias("flag_rate"))
