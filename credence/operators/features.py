"""TF-IDF: document frequencies, vocabulary and document vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.stopwords import ENGLISH
from credence.functions.text import term_counts
from credence.operators.lookup import TermLookup, lookup
from credence.operators.prune import frequent_words, only_frequent
from credence.operators.ranking import sorted_numbers
from credence.schema import MAX_DF, MIN_DF
from credence.session import stage


def explode_terms(docs: DataFrame, keep: Sequence[str], input_col: str = "input",
                  stop_words: Iterable[str] | None = None) -> DataFrame:
    """One row per document and distinct term: ``keep`` + term, tf; null ones for a document without terms.

    Documents that bring their counted terms, in a column ``terms``, are not counted again.
    """
    stop = ENGLISH if stop_words is None else stop_words
    terms = F.col("terms") if "terms" in docs.columns else term_counts(input_col, stop)
    # The outer form on purpose: for the inner one the optimizer adds a filter that counts the terms again.
    counted = docs.select(*keep, F.explode_outer(terms).alias("_t"))
    return counted.select(*keep, F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"))


def document_frequency(docs: DataFrame, stop_words: Iterable[str] | None = None, least: dict[str, int] | None = None) -> DataFrame:
    """(route, term, df, cf). Both sums combine map-side, so frequent terms do not skew.

    With ``least``, documents per route, terms that are surely in fewer are left out before anything is shuffled, but
    some others that are in fewer may remain. ``docs`` then bring their counted terms and are read three times.
    """
    terms = explode_terms(docs, ["route"], stop_words=stop_words).where("term IS NOT NULL")
    if least:
        terms = only_frequent(terms, frequent_words(docs, least), list(least))
    return terms.groupBy("route", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def sublinear_tf(tf: Column | str) -> Column:
    return 1 + F.log(tf)


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def fit_vocabulary(docs: DataFrame, max_features: int | None = None, min_df: dict[str, int] | None = None,
                   max_df: float = MAX_DF, stop_words: Iterable[str] | None = None) -> DataFrame:
    """Staged table (route, term, idx, df, cf, n_docs, idf) from ``docs`` (route, input).

    Keeps all terms with min_df <= df <= max_df * N: ``min_df`` is the way to keep a vocabulary small. With
    ``max_features`` only the most frequent so many of each route, ties by term. ``idx`` numbers a route's
    terms in their order.
    """
    sizes = {r["route"]: r["n"] for r in docs.groupBy("route").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no training rows")
    least = {r: (MIN_DF if min_df is None else min_df).get(r, 1) for r in sizes}
    floor = reduce(lambda c, r: F.when(F.col("route") == r, least[r]).otherwise(c), sizes, F.lit(1))
    n_docs = reduce(lambda c, r: F.when(F.col("route") == r, F.lit(sizes[r]).cast("bigint")).otherwise(c), sizes, F.lit(None).cast("bigint"))
    pruned = {r: n for r, n in least.items() if n > 1}
    if pruned and "terms" not in docs.columns:
        docs = stage(docs.select("route", term_counts("input", ENGLISH if stop_words is None else stop_words).alias("terms")), "counted-terms")
    kept = document_frequency(docs, stop_words, pruned).withColumn("n_docs", n_docs).where(
        (F.col("df") >= floor) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    chosen = kept if max_features is None else most_frequent(stage(kept, "terms"), max_features)
    table = numbered(chosen)
    require_terms(table, sizes)
    return table


def numbered(terms: DataFrame) -> DataFrame:
    """Staged (route, term, idx, df, cf, n_docs, idf) of (route, term, df, cf, n_docs)."""
    return stage(
        sorted_numbers(terms, ["route"], ["term"], "idx")
        .select("route", "term", "idx", "df", "cf", "n_docs", smooth_idf(F.col("df"), F.col("n_docs")).alias("idf")),
        "vocabulary")


def require_terms(table: DataFrame, routes: Iterable[str]) -> None:
    found = {r["route"] for r in table.select("route").distinct().collect()}
    for route in routes:
        if route not in found:
            raise ValueError(f"no terms remain for route {route!r}: lower min_df or raise max_df")


def most_frequent(kept: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` terms of each route with the greatest cf, ties by term.

    A histogram of cf in eighths of a power of two (a few hundred rows) tells which terms can still make
    it, so that the top-k sees about ``max_features`` rows rather than all distinct terms.
    """
    banded = kept.withColumn("band", F.floor(F.log2("cf") * 8).cast("int"))
    higher = Window.partitionBy("route").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = (banded.groupBy("route", "band").agg(F.count("*").alias("c"))
             .withColumn("above", F.coalesce(F.sum("c").over(higher), F.lit(0)))
             .where(F.col("above") < max_features)
             .groupBy("route").agg(F.min("band").alias("lowest")).collect())
    tops = [banded.where((F.col("route") == r["route"]) & (F.col("band") >= r["lowest"])).orderBy(F.desc("cf"), "term").limit(max_features)
            for r in bands]
    return reduce(DataFrame.unionByName, tops).drop("band") if tops else kept


def known_terms(docs: DataFrame, keep: Sequence[str], table: TermLookup, stop_words: Iterable[str] | None = None) -> DataFrame:
    """The known terms of each document, from a term table on (route, term), with ``x`` = tf-idf before the norm.

    Where the table is too large to be broadcast whole, counted terms are staged: they are read twice.
    """
    if not table.whole and "terms" not in docs.columns:
        docs = stage(docs.select(*keep, "route", term_counts("input", ENGLISH if stop_words is None else stop_words).alias("terms")), "counted-terms")
    terms = explode_terms(docs, [*keep, "route"], stop_words=stop_words).where("term IS NOT NULL")
    return table.match(terms).withColumn("x", sublinear_tf("tf") * F.col("idf"))


def weighted_terms(docs: DataFrame, keep: Sequence[str], table: TermLookup, stop_words: Iterable[str] | None = None) -> DataFrame:
    """``known_terms``; and one row per document without term and ``x``, so that those without a known term survive.

    Those rows (``keep`` and route of ``docs``) join nothing, so they are no key of their own in the join.
    """
    return known_terms(docs, keep, table, stop_words).unionByName(docs.select(*keep, "route"), allowMissingColumns=True)


def content(docs: DataFrame) -> str:
    return "terms" if "terms" in docs.columns else "input"


def tfidf(docs: DataFrame, vocabulary: DataFrame | TermLookup, key: str = "id",
          stop_words: Iterable[str] | None = None) -> DataFrame:
    """Long form (id, route, term, tf, tfidf), L2-normalised per document."""
    table = vocabulary if isinstance(vocabulary, TermLookup) else lookup(vocabulary.select("route", "term", "idf"))
    terms = weighted_terms(docs.select(key, "route", content(docs)), [key], table, stop_words)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))   # one document's terms
    return (terms.where("x IS NOT NULL").withColumn("tfidf", F.col("x") / norm)
            .select(key, "route", "term", "tf", "tfidf"))


def document_vectors(docs: DataFrame, vocabulary: DataFrame, keep: Sequence[str], key: str = "id",
                     stop_words: Iterable[str] | None = None) -> DataFrame:
    """Staged (key, keep, route, indices, values): one L2-normalised sparse row per document.

    A document's terms are collected where it is read; what is shuffled is its vector, not its text.
    """
    terms = weighted_terms(docs.select(key, *keep, "route", content(docs)), [key, *keep],
                           lookup(vocabulary.select("route", "term", "idx", "idf")), stop_words)
    entries = F.sort_array(F.collect_list(F.when(F.col("x").isNotNull(), F.struct("idx", "x"))))
    rows = terms.groupBy(key, *keep, "route").agg(entries.alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l2"))
    return stage(
        rows.select(key, *keep, "route",
                    F.col("e.idx").alias("indices"),
                    F.transform("e.x", lambda v: v / F.col("l2")).alias("values")),
        "vectors")
