"""Model versions as tables: versioned folders, and a pointer written last."""

from __future__ import annotations

import json
import time
import warnings
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators.evaluate import OVERALL
from credence.operators.models import CredibilityModel, global_top_terms, require_model
from credence.plans.report import metrics_documents
from credence.plans.train import Trained, routing, select_best
from credence.schema import CLAIM_MAX_WORDS, LABELS, RELIABLE_GRADES, UNRELIABLE_GRADES
from credence.session import stage

TERMS = T.StructType([
    T.StructField("route", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("idf", T.DoubleType()), T.StructField("weight", T.DoubleType())])
POINTER = "version string, published_at timestamp, model string, bias map<string,double>, routes array<string>, " \
          "stop_words array<string>, metrics string, max_chars int"


def metrics_document(trained: Trained, data_source: str, route_of_source: dict[str, str] | None = None) -> dict:
    """Everything reported about a training run, as one nested record (bounded by models, sources, k terms).

    Its keys are fixed values of the data model.
    """
    metrics = stage(trained.metrics(), "metrics")
    best = select_best(trained, metrics)
    rows = trained.fitted.rows
    models = {}
    for r in metrics_documents(metrics, routing(trained, route_of_source)).collect():
        models[r["model"]] = {
            "overall": r["overall"].asDict(True), "by_source": {k: v.asDict(True) for k, v in r["by_source"].items()},
            "routing_accuracy": r["routing_accuracy"], "train_seconds": trained.seconds.get(r["model"])}
    tops = {}
    for r in global_top_terms(best.terms, best.routes).orderBy("route", "direction", "rank").collect():
        tops.setdefault(r["route"], {"unreliable": [], "reliable": []})[r["direction"]].append(
            {"term": r["term"], "weight": r["weight"]})
    counted = rows.groupBy("source", "label", "is_test").agg(F.count("*").alias("n")).collect()
    def total(pick) -> int:
        return sum(r["n"] for r in counted if pick(r))
    features = {r["route"]: r["n"] for r in
                trained.fitted.vocabulary.groupBy("route").agg(F.count("*").alias("n")).collect()}
    return {
        "version": trained.version,
        "trained_at": trained.trained_at.isoformat(),
        "best_model": best.name,
        "selection_metric": "macro_f1",
        "architecture": "routed",
        "routing_rule": f"claim: metadata given, or no title and fewer than {CLAIM_MAX_WORDS} words; else article",
        "n_train": total(lambda r: not r["is_test"]),
        "n_test": total(lambda r: r["is_test"]),
        "n_features": sum(features.values()),
        "features_by_route": features,
        "rows_by_source": {s: total(lambda r: r["source"] == s) for s in sorted({r["source"] for r in counted})},
        "rows_by_label": {name: total(lambda r: r["label"] == k) for k, name in LABELS.items()},
        "liar_label_mapping": {"reliable": RELIABLE_GRADES, "unreliable": UNRELIABLE_GRADES},
        "models": models,
        "top_terms": tops.get("article") or next(iter(tops.values())),
        "top_terms_by_route": tops,
        "data_source": data_source,
    }


def publish(model: CredibilityModel, base: str, metrics: dict | None = None) -> str:
    """Write the model's tables under ``base/v<version>``, then append the pointer row that makes it current.

    Readers follow the newest pointer row, so they see the old model or the whole new one.
    """
    spark = model.terms.sparkSession
    path = f"{base}/v{model.version}"
    model.terms.select(*TERMS.names).write.mode("overwrite").parquet(f"{path}/terms")
    document = metrics if metrics is not None else model.metrics
    spark.createDataFrame([(json.dumps(document, indent=2, ensure_ascii=False),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/metrics", lineSep="\n")
    row = (model.version, datetime.now(timezone.utc), model.name, model.bias, model.routes,
           None if model.stop_words is None else list(model.stop_words), json.dumps(document, ensure_ascii=False), model.max_chars)
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{base}/latest")
    return path


def pointer(spark: SparkSession, base: str) -> T.Row | None:
    """The newest pointer row, or None when nothing was published there."""
    try:
        log = spark.read.schema(POINTER).parquet(f"{base}/latest")
        return log.orderBy(F.desc("published_at"), F.desc("version")).limit(1).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(spark: SparkSession, base: str, row: T.Row) -> CredibilityModel:
    """The model of a pointer row; its term table is read and measured once, here."""
    path = f"{base}/v{row['version']}"
    return CredibilityModel(
        row["model"], row["version"], spark.read.schema(TERMS).parquet(f"{path}/terms"), {r: row["bias"][r] for r in row["routes"]},
        None if row["stop_words"] is None else tuple(row["stop_words"]), path, json.loads(row["metrics"]), row["max_chars"])


UNREADABLE = (PySparkException, Py4JError, ValueError, OSError)


def newest(spark: SparkSession, current: CredibilityModel | None, bases: tuple[str, ...]) -> CredibilityModel | None:
    """The model of the first base that can be read: ``current`` where that is the one, None if there is none.

    A base that fails to read, be it the pointer or the tables it points to, is passed over with a warning.
    """
    for base in bases:
        try:
            row = pointer(spark, base)
            if row is None:
                continue
            path = f"{base}/v{row['version']}"
            same = current is not None and (current.version, current.name) == (row["version"], row["model"]) and current.origin in (None, path)
            return current if same else load(spark, base, row)
        except UNREADABLE as e:
            warnings.warn(f"{base} cannot be read, trying the next: {e}", stacklevel=3)
    return None


def load_latest(spark: SparkSession, *bases: str) -> CredibilityModel | None:
    """The current model of the first base that has a readable one; None if no base has."""
    return newest(spark, None, bases)


def reload_if_changed(current: CredibilityModel | None, spark: SparkSession, *bases: str) -> CredibilityModel | None:
    """``current`` while its version is still the published one, or nothing can be read; else the newly published model."""
    return newest(spark, current, bases) or current


def wait_for_model(spark: SparkSession, *bases: str, seconds: float = 0, every: float = 5) -> CredibilityModel:
    """The current model, waiting up to ``seconds`` for one to be published; an error if none is."""
    end = time.monotonic() + seconds
    while (found := load_latest(spark, *bases)) is None and time.monotonic() < end:
        time.sleep(min(every, max(0.0, end - time.monotonic())))
    return require_model(found)


def model_info(model: CredibilityModel) -> dict:
    return {**model.metrics, "loaded_from": model.origin}


def metrics_table(spark: SparkSession, document: dict) -> DataFrame:
    """Flat (version, model, scope, metric, value) rows of a metrics document."""
    rows = [
        (document["version"], name, scope, metric, float(value))
        for name, m in document["models"].items()
        for scope, scores in {OVERALL: m["overall"], **m["by_source"]}.items()
        for metric, value in scores.items() if isinstance(value, (int, float))
    ]
    return spark.createDataFrame(rows, "version string, model string, scope string, metric string, value double")
