"""Every query with SQL agrees with DuckDB on the smallest tables; the rest return rows."""

from pathlib import Path

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUICK = [
    "tfidf_head_tail", "lr_text_predict", "csv_header_check", "registry_fallback", "landed_compaction", "landed_latest", "stream_publish_once", "stream_last_arrivals",
    "stream_minute_counts", "raw_last_record", "lr_dense_weights", "fallback_route", "stream_repeats", "metrics_document_scores", "source_selection", "prepared_inputs_capped", "feed_stats", "feed_freshness",
    "normalize_documents", "normalize_conversations", "union_all_sources", "grade_binarize", "label_cast", "record_validation",
    "dedup_keep_last", "interleave_limit", "clean_documents", "clean_pages", "meta_tokens_conversations", "prepared_inputs",
    "route_counts", "token_stats", "vocabulary_topk", "tfidf_documents", "stratified_split_rows", "class_weights", "nb_weights",
    "nb_metrics_overall", "nb_metrics_by_source", "nb_explain_topk", "annotate_spans", "roc_auc_events", "recent_feed",
    "throughput_buckets", "windowed_flag_rate", "article_csv_scan", "claim_tsv_scan", "json_lines_scan", "stream_land", "stream_flag_rate",
]
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the driver's tables")


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUICK) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = connect(SF_DIR)
    assert differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 2
