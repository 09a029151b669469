"""Reports on predictions and on model quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.text import let, pretty_term
from credence.operators.evaluate import OVERALL, SCORES, confusion_matrix
from credence.schema import LABELS

# The key figures of a comparison.
KPIS = ["accuracy", "macro_f1", "roc_auc", "recall"]


# ----------------------------------------------------------------------------- live feed

def recent(predictions: DataFrame, limit: int = 50, ties: Sequence[str] = ("id",)) -> DataFrame:
    """The newest ``limit`` verdicts, newest first; rows without a time come last."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return predictions.orderBy(F.desc_nulls_last("scored_at"), *ties).limit(limit)


def feed_stats(feed: DataFrame) -> DataFrame:
    """One row: verdicts, share of unreliable ones, mean confidence (0 on an empty feed)."""
    flagged = (F.col("label") == LABELS[1]).cast("int")
    return feed.agg(
        F.count("*").alias("n"), F.coalesce(F.avg(flagged), F.lit(0.0)).alias("unreliable_share"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def throughput(feed: DataFrame, now: Column, buckets: int = 15, seconds: int = 60) -> DataFrame:
    """(bucket, n): verdicts per minute counted back from ``now``; the last bucket is the newest."""
    age = F.floor((now.cast("double") - F.col("scored_at").cast("timestamp").cast("double")) / seconds)
    counted = (feed.withColumn("age", age).where(F.col("age").between(0, buckets - 1))
               .groupBy((buckets - 1 - F.col("age")).alias("bucket")).agg(F.count("*").alias("n")))
    every = feed.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def freshness(feed: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """One row: the newest verdict's time and whether it is less than a minute old."""
    newest = feed.agg(F.max("scored_at").alias("newest"))
    limit = F.col("newest").cast("timestamp").cast("double") > now.cast("double") - seconds
    return newest.select("newest", F.coalesce(limit, F.lit(False)).alias("is_live"))


def window_rates(feed: DataFrame, minutes: int = 1) -> DataFrame:
    """Verdicts and flag rate per tumbling window; the same for a table and, with a watermark, a stream."""
    flagged = F.count_if(F.col("label") == LABELS[1])
    return (feed.groupBy(F.window("scored_at", f"{minutes} minutes").alias("w"))
            .agg(F.count("*").alias("n"), flagged.alias("flagged"), F.avg("confidence").alias("mean_confidence"))
            .select(F.col("w.start").alias("window_start"), "n", "flagged",
                    (F.col("flagged") / F.col("n")).alias("flag_rate"), "mean_confidence"))


def feed_terms(predictions: DataFrame, k: int = 4) -> DataFrame:
    """Adds ``feed_terms``: the first ``k`` terms that agree with the verdict, as shown to a reader."""
    agreeing = F.filter("top_terms", lambda t: t["direction"] == F.col("label"))
    return predictions.withColumn(
        "feed_terms", F.transform(F.slice(agreeing, 1, k), lambda t: pretty_term(t["term"])))


def verdict_terms(predictions: DataFrame, k: int = 6) -> DataFrame:
    """Adds ``terms_unreliable`` and ``terms_reliable``: the first ``k`` terms of each side with strengths."""
    def strongest(terms: Column) -> Column:
        return F.greatest(F.array_max(F.transform(terms, lambda t: F.abs(t["weight"]))), F.lit(1e-9))
    def side(direction: str, terms: Column, greatest: Column) -> Column:
        mine = F.slice(F.filter(terms, lambda t: t["direction"] == direction), 1, k)
        return F.transform(mine, lambda t: F.struct(
            pretty_term(t["term"]).alias("term"), t["weight"].alias("weight"),
            (F.abs(t["weight"]) / greatest).alias("strength")))
    both = let(F.col("top_terms"), lambda terms: let(strongest(terms), lambda m: F.struct(
        side(LABELS[1], terms, m).alias("u"), side(LABELS[0], terms, m).alias("r"))))
    return predictions.withColumn("_sides", both).withColumns(
        {"terms_unreliable": F.col("_sides.u"), "terms_reliable": F.col("_sides.r")}).drop("_sides")


def side_terms(predictions: DataFrame, k: int = 6) -> DataFrame:
    """(id, side, rank, term, weight, strength): the terms of ``verdict_terms`` as rows, both sides from one pass."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"terms_{side}").alias("terms")) for side in (LABELS[1], LABELS[0])])
    rows = verdict_terms(predictions, k).select("id", F.explode_outer(sides).alias("s"))
    return rows.select("id", "s.side", F.posexplode_outer("s.terms").alias("rank", "t")).where("rank IS NOT NULL").select("id", "side", "rank", "t.*")


# ----------------------------------------------------------------------------- model quality

def long_metrics(metrics: DataFrame, names: Sequence[str] = SCORES) -> DataFrame:
    """(model, scope, metric, value)."""
    return metrics.unpivot(["model", "scope"], list(names), "metric", "value")


def comparison(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per metric, one column per model, overall scores."""
    rows = long_metrics(metrics.where(F.col("scope") == OVERALL))
    return rows.groupBy("metric").pivot("model", list(models)).agg(F.first("value"))


def kpi_delta(metrics: DataFrame, best: str, other: str) -> DataFrame:
    """(metric, value, delta): the best model's overall scores and their lead over the other model."""
    wide = comparison(metrics, [best, other]).where(F.col("metric").isin(KPIS))
    return wide.select("metric", F.col(best).alias("value"), F.round(F.col(best) - F.col(other), 4).alias("delta"))


def confusion_shares(metrics: DataFrame) -> DataFrame:
    """(model, scope, actual, predicted, n, share) of the four cells."""
    total = F.greatest(F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.lit(1))
    cells = F.array(*[
        F.struct(F.lit(LABELS[a]).alias("actual"), F.lit(LABELS[p]).alias("predicted"), F.col(c).alias("n"),
                 (F.col(c) / total).alias("share"))
        for a, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return metrics.select("model", "scope", F.explode(cells).alias("c")).select("model", "scope", "c.*")


def source_table(metrics: DataFrame, model: str) -> DataFrame:
    """(source, n, accuracy, macro_f1, roc_auc) of one model."""
    return metrics.where((F.col("model") == model) & (F.col("scope") != OVERALL)).select(
        F.col("scope").alias("source"), "n", "accuracy", "macro_f1", "roc_auc")


def lineage(rows: DataFrame, path: str, selection_metric: str = "macro_f1") -> DataFrame:
    """(source, n, path, selection_metric): which rows a model was built from."""
    return rows.groupBy("source").agg(F.count("*").alias("n")).select(
        "source", "n", F.lit(path).alias("path"), F.lit(selection_metric).alias("selection_metric"))


def scores_struct() -> Column:
    return F.struct("n", *SCORES, confusion_matrix().alias("confusion_matrix"))


def metrics_documents(metrics: DataFrame, routing: DataFrame) -> DataFrame:
    """One row per model: nested overall scores, scores by source and routing accuracy."""
    scoped = metrics.select("model", "scope", scores_struct().alias("s"))
    by_source = F.map_from_entries(F.sort_array(F.collect_list(
        F.when(F.col("scope") != OVERALL, F.struct("scope", "s")))))
    overall = F.max(F.when(F.col("scope") == OVERALL, F.col("s")))
    return scoped.groupBy("model").agg(overall.alias("overall"), by_source.alias("by_source")).join(routing, "model")
