"""Classification metrics as aggregations over a table of predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.ranking import running_totals
from credence.schema import ROUTE_OF_SOURCE, THRESHOLD
from credence.session import stage

OVERALL = "overall"
COUNTS = ["n", "tn", "fp", "fn", "tp"]
SCORES = ["accuracy", "precision", "recall", "f1", "macro_f1", "roc_auc"]


def expected_route(source: Column, route_of_source: dict[str, str]) -> Column:
    return reduce(lambda acc, kv: F.when(source == kv[0], kv[1]).otherwise(acc), route_of_source.items(),
                  F.lit("article"))


def with_overall(df: DataFrame) -> DataFrame:
    """Every row once under its source and once under 'overall', as ``scope``."""
    scopes = F.array(F.col("source"), F.lit(OVERALL))
    return df.withColumn("scope", F.explode(scopes)).drop("source")


def confusion(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(model, scope, n, tn, fp, fn, tp): counted per source, then rolled up on the small result."""
    y, flagged = F.col("label") == 1, F.col("p") >= threshold
    per_source = predictions.groupBy("model", "source").agg(
        F.count("*").alias("n"), F.count_if(~y & ~flagged).alias("tn"), F.count_if(~y & flagged).alias("fp"),
        F.count_if(y & ~flagged).alias("fn"), F.count_if(y & flagged).alias("tp"))
    return with_overall(per_source).groupBy("model", "scope").agg(*[F.sum(c).alias(c) for c in COUNTS])


def roc_auc(predictions: DataFrame) -> DataFrame:
    """(model, scope, roc_auc): share of (unreliable, reliable) pairs in the right order, ties half.

    Rows are counted per distinct score first; the rank is a running total that never puts a whole
    group into one task. Null when a scope has one class only.
    """
    per_score = predictions.groupBy("model", "source", "p").agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    points = stage(
        with_overall(per_score).groupBy("model", "scope", "p").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")),
        "auc-points")
    below = running_totals(points, ["model", "scope"], "p", {"n0_below": F.col("n0")})
    won = F.col("n1").cast("double") * (F.col("n0_below") + F.col("n0") / 2)
    sums = below.groupBy("model", "scope").agg(
        F.sum(won).alias("won"), F.sum("n1").cast("double").alias("n1"), F.sum("n0").cast("double").alias("n0"))
    pairs = F.col("n1") * F.col("n0")
    return sums.select("model", "scope", F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def derived_scores() -> dict[str, Column]:
    """Scores of the four counts, class 1 = unreliable; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    has1, has0 = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    return {
        "accuracy": (tn + tp) / F.col("n"),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": f1,
        "macro_f1": (f1 * has1 + f0 * has0) / (has1 + has0),
    }


def routing_accuracy(predictions: DataFrame, route_of_source: dict[str, str] | None = None) -> DataFrame:
    """(model, routing_accuracy): share of rows whose rule route is the route of their source."""
    expected = expected_route(F.col("source"), route_of_source or ROUTE_OF_SOURCE)
    return predictions.groupBy("model").agg(
        F.round(F.avg((F.col("route") == expected).cast("int")), 4).alias("routing_accuracy"))


def evaluate(predictions: DataFrame) -> DataFrame:
    """Metrics per model and scope ('overall' and each source), scores rounded to 4 places.

    ``predictions``: (model, source, label, p); read twice, so pass a staged table.
    """
    scored = confusion(predictions).join(roc_auc(predictions), ["model", "scope"]).withColumns(derived_scores())
    return scored.select("model", "scope", *COUNTS, *[F.round(s, 4).alias(s) for s in SCORES])


def confusion_matrix() -> Column:
    """Rows actual, columns predicted, [reliable, unreliable]."""
    return F.array(F.array("tn", "fp"), F.array("fn", "tp"))


def best_model(metrics: DataFrame, order: list[str]) -> DataFrame:
    """The model with the greatest overall macro-F1; the earlier one in ``order`` wins ties."""
    rank = F.array_position(F.lit(order), F.col("model"))
    return metrics.where(F.col("scope") == OVERALL).orderBy(F.desc("macro_f1"), rank).limit(1)
