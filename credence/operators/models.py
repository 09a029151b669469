"""Classifiers as term tables: naive Bayes, logistic regression, scoring and explanations.

Both classifiers end up as one weight per (route, term) and one bias per route, so that a single
query scores either: p = 1 / (1 + exp(-(bias + sum(tfidf * weight)))).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.stopwords import ENGLISH
from credence.functions.text import blank_null, label_name, let, prepare, route_for, term_counts
from credence.operators import logistic as logistic_regression
from credence.operators.features import known_terms, weighted_terms
from credence.operators.lookup import TermLookup, lookup
from credence.operators.memory import released
from credence.operators.normalize import with_defaults
from credence.schema import EXPLAIN_K, LR_C, LR_MAX_ITER, LR_TOL, NB_ALPHA, PREDICTION, THRESHOLD, VOCABULARY_K
from credence.session import stage

TIE = 1e-9                 # weights that differ by less may be equal in ``tie_safe``
GREATEST_NORM = 1e6        # of a document's tf-idf values: 10 million different terms of 300 each


@dataclass
class CredibilityModel:
    """``terms``: (route, term, idf, weight); ``bias``: route -> bias, first route is the fallback;
    ``max_chars``: cleaned characters of a text that were used, None for all; ``lookup``: how ``terms`` are looked up."""

    name: str
    version: str
    terms: DataFrame
    bias: dict[str, float]
    stop_words: tuple[str, ...] | None = None
    origin: str | None = None
    metrics: dict = field(default_factory=dict)
    max_chars: int | None = None
    lookup: TermLookup | None = None

    def __post_init__(self) -> None:
        if self.lookup is None:
            self.lookup = lookup(self.terms)

    @property
    def routes(self) -> list[str]:
        return list(self.bias)


def by_route(values: dict[str, float], route: Column | str = "route") -> Column:
    c = F.col(route) if isinstance(route, str) else route
    return reduce(lambda acc, kv: F.when(c == kv[0], F.lit(kv[1])).otherwise(acc), values.items(),
                  F.lit(None).cast("double"))


def known_route(route: Column, routes: Sequence[str]) -> Column:
    """The rule's route, or the model's first one when it has no such sub-model."""
    return F.when(route.isin(list(routes)), route).otherwise(F.lit(routes[0]))


# ----------------------------------------------------------------------------- fitting

def class_counts(vectors: DataFrame) -> DataFrame:
    """(route, n, n0, n1), one row per route."""
    one = F.col("label") == 1
    return vectors.groupBy("route").agg(
        F.count("*").alias("n"), F.count_if(~one).alias("n0"), F.count_if(one).alias("n1"))


def class_weights(counts: DataFrame) -> DataFrame:
    """Balanced weights n / (2 * n_class) per route and class."""
    return counts.select(
        "route", F.explode(F.array(
            F.struct(F.lit(0).alias("label"), (F.col("n") / (2 * F.col("n0"))).alias("weight")),
            F.struct(F.lit(1).alias("label"), (F.col("n") / (2 * F.col("n1"))).alias("weight")))).alias("c")
    ).select("route", "c.*")


def nb_sums(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Staged (route, term, idf, s0, s1): sums of the tf-idf values of every class over the whole vocabulary."""
    entries = vectors.select("route", "label", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    value = F.col("e.values")
    sums = entries.groupBy("route", F.col("e.indices").alias("idx")).agg(
        F.sum(F.when(F.col("label") == 0, value).otherwise(0.0)).alias("s0"),
        F.sum(F.when(F.col("label") == 1, value).otherwise(0.0)).alias("s1"))
    return stage(
        vocabulary.select("route", "idx", "term", "idf").join(sums, ["route", "idx"], "left")
        .select("route", "term", "idf", F.coalesce("s0", F.lit(0.0)).alias("s0"), F.coalesce("s1", F.lit(0.0)).alias("s1")),
        "nb-sums")


def nb_weight(full: DataFrame, alpha: float = NB_ALPHA) -> Column:
    """Multinomial naive Bayes as a column over the values of ``nb_sums``: ll(1) - ll(0).

    ll(class) = ln((N_ct + alpha) / (N_c + alpha * V)) over the whole vocabulary of the route.
    """
    totals = full.groupBy("route").agg(F.sum("s0").alias("t0"), F.sum("s1").alias("t1"), F.count("*").alias("v")).collect()     # a row per route
    def ll(s: str, t: str) -> Column:
        return F.log((F.col(s) + F.lit(alpha)) / by_route({r["route"]: r[t] + alpha * r["v"] for r in totals}))
    return ll("s1", "t1") - ll("s0", "t0")


def nb_bias(counts: Iterable) -> dict[str, float]:
    """Prior log-odds from the unsmoothed class shares."""
    return {r["route"]: math.log(r["n1"] / r["n0"]) for r in counts}


def lr_weights(vectors: DataFrame, vocabulary: DataFrame, counts: Sequence, c: dict[str, float] | None = None,
               max_iter: int = LR_MAX_ITER, tol: float = LR_TOL) -> tuple[DataFrame, dict[str, float]]:
    """((route, idx, weight), route -> intercept) of one logistic regression per route, see ``logistic``."""
    sizes = {r["route"]: r["v"] for r in vocabulary.groupBy("route").agg(F.count("*").alias("v")).collect()}
    weights, bias, _ = logistic_regression.fit(
        vectors, sizes, {r["route"]: (r["n0"], r["n1"]) for r in counts}, LR_C if c is None else c, max_iter, tol)
    return weights, bias


# ----------------------------------------------------------------------------- scoring

def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probabilities(docs: DataFrame, table: TermLookup, bias: dict[str, dict[str, float]], keep: Sequence[str],
                key: str = "id", stop_words: Iterable[str] | None = None) -> DataFrame:
    """(key, keep, route, model, p) for every model with a ``w_<model>`` column in ``table``.

    One pass over the exploded terms serves all models; the sums combine map-side, so that only one
    short row per document is shuffled. ``docs``: unique key, ``route`` known to the models, ``input``.
    """
    terms = weighted_terms(docs, [key, *keep], table, stop_words)
    x = F.col("x")
    sums = terms.groupBy(key, *keep, "route").agg(
        F.sum(x * x).alias("ss"), *[F.sum(x * F.col(f"w_{m}")).alias(f"dot_{m}") for m in bias])
    p = [F.struct(F.lit(m).alias("model"),
                  logistic(by_route(b) + F.coalesce(F.col(f"dot_{m}") / F.sqrt("ss"), F.lit(0.0))).alias("p"))
         for m, b in bias.items()]
    return sums.select(key, *keep, "route", F.explode(F.array(*p)).alias("s")).select(key, *keep, "route", "s.*")


def tie_safe(weight: Column | str) -> Column:
    """Sort key of a weight: equal to nine places is a tie, so that the order in which a shuffle
    happened to add up the numbers does not decide a ranking."""
    return F.round(weight, 9)


def ranked_terms(entries: Column, k: int) -> Column:
    """Top ``k`` unreliable then top ``k`` reliable contributions; ties by term; empty when none.

    ``entries``: array of struct(weight, term) of one document.
    """
    def top(sign: int, direction: str) -> Column:
        side = F.filter(entries, lambda e: e["weight"] * sign > 0)
        ordered = F.sort_array(F.transform(
            side, lambda e: F.struct(tie_safe(e["weight"] * -sign).alias("o"), e["term"].alias("term"))))
        return F.transform(F.slice(ordered, 1, k), lambda e: F.struct(
            e["term"].alias("term"), F.round(e["o"] * -sign, 4).alias("weight"), F.lit(direction).alias("direction")))
    return F.concat(top(1, "unreliable"), top(-1, "reliable"))


def strongest_parts(terms: DataFrame, key: str, k: int) -> DataFrame:
    """(key, ss, dot, e) of (key, x, part, term): per document, as far as a batch holds it, the sums of x squared and of the
    parts, and the parts that may be among its ``k`` greatest or ``k`` smallest ones, as array of struct(weight, term).

    A part is left out if ``k`` others surely precede it: they are greater by more than rounding hides, or
    equal with smaller terms. So the order in ``ranked_terms``, ties included, is that of all parts.
    """
    hidden = TIE * GREATEST_NORM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, part = (b.column(c).to_numpy(zero_copy_only=False) for c in (key, "x", "part"))
            if not len(ids):
                continue
            order = np.argsort(ids, kind="stable")
            ids, x, part = ids[order], x[order], part[order]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
            side = 2 * doc + (part < 0)
            size = np.abs(part)
            ranked = np.lexsort((-size, side))
            ranked = ranked[part[ranked] != 0]
            group, size = side[ranked], size[ranked]
            first = np.searchsorted(group, group)                   # of the group, for every place
            last = first + k - 1
            full = last < len(group)
            full[full] = group[last[full]] == group[full]
            least = np.where(full, size[np.minimum(last, max(len(size) - 1, 0))], 0.0) if len(size) else size
            ranked = ranked[size >= least - hidden]
            found = pa.table({"side": side[ranked], "size": np.abs(part[ranked]), "at": ranked, "term": b.column("term").take(pa.array(order[ranked]))})
            found = found.take(pc.sort_indices(found, [("side", "ascending"), ("size", "descending"), ("term", "ascending")]))
            group, size = found.column("side").to_numpy(), found.column("size").to_numpy()
            same = np.concatenate([[True], (group[1:] != group[:-1]) | (size[1:] != size[:-1])])[:len(group)]
            equal = np.arange(len(group)) - np.maximum.accumulate(np.where(same, np.arange(len(group)), 0))
            found = found.filter(pa.array(equal < k))
            offsets = np.searchsorted(found.column("side").to_numpy() // 2, np.arange(len(starts) + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays(
                [pa.array(part[found.column("at").to_numpy()]), found.column("term").combine_chunks()], ["weight", "term"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[starts]), pa.array(np.add.reduceat(x * x, starts)), pa.array(np.add.reduceat(part, starts)),
                 pa.ListArray.from_arrays(pa.array(offsets), entries)], [key, "ss", "dot", "e"])
    return terms.select(F.col(key).cast("bigint").alias(key), "x", "part", "term").mapInArrow(
        released(run), f"{key} bigint, ss double, dot double, e array<struct<weight: double, term: string>>")


def score_inputs(docs: DataFrame, model: CredibilityModel, key: str, k: int = EXPLAIN_K, keep: Sequence[str] = ()) -> DataFrame:
    """(key, route, keep, p, top_terms) of documents (unique integer key, route, input): probability and explanation together.

    Where a document's terms are looked up, only those that may be listed go on; the kept columns travel in a row
    of their own, and come back from the same aggregation: one shuffle, of short rows, and no join.
    """
    kept = docs.select(key, F.struct("route", *keep).alias("_kept"))
    terms = known_terms(docs, [key], model.lookup, model.stop_words)
    parts = strongest_parts(terms.withColumn("part", F.col("x") * F.col("weight")), key, k)
    rows = parts.unionByName(kept, allowMissingColumns=True).groupBy(key).agg(
        F.sum("ss").alias("ss"), F.sum("dot").alias("dot"), F.first("_kept", ignorenulls=True).alias("_kept"),
        F.flatten(F.collect_list("e")).alias("e"))
    l2 = F.sqrt("ss")
    scaled = let(l2, lambda n: F.transform("e", lambda t: F.struct((t["weight"] / n).alias("weight"), t["term"].alias("term"))))
    z = by_route(model.bias, "_kept.route") + F.coalesce(F.col("dot") / l2, F.lit(0.0))
    return rows.select(key, *[F.col(f"_kept.{c}").alias(c) for c in ("route", *keep)], logistic(z).alias("p"),
                       ranked_terms(scaled, k).alias("top_terms"))


def verdict(p: Column | str, threshold: float = THRESHOLD) -> dict[str, Column]:
    """Label, confidence and probabilities of P(unreliable)."""
    c = F.col(p) if isinstance(p, str) else p
    flagged = c >= threshold
    label_id = F.when(flagged, 1).otherwise(0)
    return {
        "label": label_name(label_id),
        "label_id": label_id,
        "confidence": F.round(F.when(flagged, c).otherwise(1 - c), 4),
        "probabilities": F.create_map(
            F.lit("reliable"), F.round(1 - c, 4), F.lit("unreliable"), F.round(c, 4)),
    }


def snippet(text: Column | str = "text", n: int = 280) -> Column:
    return F.substring(blank_null(text), 1, n)


def score(df: DataFrame, model: CredibilityModel, k: int = EXPLAIN_K, passthrough: Sequence[str] = (),
          position: str | None = None) -> DataFrame:
    """Prediction records for rows with any of id, title, text, metadata, source, ingested_at.

    Ids may repeat, so rows first get a number of their own, fixed by writing the prepared rows to
    the staging folder: cleaning then runs once, and a document's terms meet on a unique key. With
    ``position`` that number is returned under this name; sorted by it the results are in input order.
    """
    routes = model.routes
    have = with_defaults(df)
    rule = known_route(route_for(), routes)
    def maybe(name: str, default: Column) -> Column:
        return F.col(name) if name in df.columns else default
    content = prepare("route", max_chars=model.max_chars).alias("input")
    if not model.lookup.whole:          # terms are read twice then, and counted once
        content = term_counts(content, ENGLISH if model.stop_words is None else model.stop_words).alias("terms")
    rows = stage(
        have.withColumn("route", rule).select(
            F.monotonically_increasing_id().alias("_row"),
            maybe("id", F.lit(None)).cast("string").alias("id"),
            "title", snippet().alias("snippet"),
            F.coalesce(maybe("source", F.lit(None)).cast("string"), F.lit("live")).alias("source"),
            maybe("ingested_at", F.lit(None)).cast("timestamp").alias("submitted_at"),
            "route", content, *[F.col(c).alias(f"_p_{c}") for c in passthrough]),
        "rows")
    kept = [c for c in rows.columns if c not in ("_row", "route", "input", "terms")]
    scored = score_inputs(rows, model, "_row", k, kept)
    fields = {
        **verdict("p"), "scored_at": F.current_timestamp(), "model": F.lit(model.name),
        "model_version": F.lit(model.version),
    }
    return scored.select(
        *[fields.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in PREDICTION.fields],
        *[F.col(f"_p_{c}").alias(c) for c in passthrough], *([F.col("_row").alias(position)] if position else []))


def require_model(model: CredibilityModel | None) -> CredibilityModel:
    if model is None:
        raise LookupError("the registry holds no published model; publish one before scoring")
    return model


def explode_explanations(predictions: DataFrame, key: str = "id") -> DataFrame:
    """One row per document and listed term, with its rank and relative strength."""
    def with_strength(terms: Column) -> Column:
        strongest = F.greatest(F.array_max(F.transform(terms, lambda t: F.abs(t["weight"]))), F.lit(1e-9))
        return let(strongest, lambda m: F.transform(terms, lambda t: F.struct(
            t["term"].alias("term"), t["weight"].alias("weight"), t["direction"].alias("direction"), (F.abs(t["weight"]) / m).alias("strength"))))
    # Bound once, and the outer form: for the inner one the optimizer adds a filter that ranks the terms again.
    rows = predictions.select(key, "label", "route", F.posexplode_outer(let(F.col("top_terms"), with_strength)).alias("rank", "t"))
    return rows.where("rank IS NOT NULL").select(key, "label", "route", "rank", "t.*")


def global_top_terms(terms: DataFrame, routes: Sequence[str], k: int = VOCABULARY_K) -> DataFrame:
    """(route, direction, rank, term, weight): the k largest and k smallest weights of every route."""
    parts = []
    for route in routes:
        for direction, order in (("unreliable", tie_safe("weight").desc()), ("reliable", tie_safe("weight").asc())):
            best = terms.where(F.col("route") == route).orderBy(order, "term").limit(k)   # k rows
            rank = F.row_number().over(Window.partitionBy("route").orderBy(order, "term"))
            parts.append(best.select("route", F.lit(direction).alias("direction"), rank.alias("rank"), "term",
                                     F.round("weight", 4).alias("weight")))
    return reduce(DataFrame.unionByName, parts)

