"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from credence.llm import binary_output, collocations, decontaminate, html_extract, jaccard, lang_id, merkle, packing, simhash, token_counts, topk, toxicity, url_filter
from credence.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op4_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_token_id_output(spark, sf_dir):
    return binary_output.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op10_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_phrase_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))


@query
def op12_simhash_near_copies(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))
