"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES choose what runs."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from credence.catalog.queries import QUERIES  # noqa: E402
from credence.session import get_spark  # noqa: E402

HEADLINE = [
    "normalize_documents", "union_all_sources", "clean_documents", "clean_pages", "prepared_inputs", "routing_accuracy",
    "record_validation", "dedup_keep_last", "interleave_sources", "token_stats", "doc_frequency", "vocabulary",
    "tfidf_documents", "stratified_split_rows", "nb_weights", "nb_predict", "nb_metrics_by_source", "roc_auc_events",
    "score_batch", "nb_explain_topk", "annotate_spans", "lr_metrics", "feed_stats", "throughput_buckets",
    "windowed_flag_rate", "article_csv_scan", "json_lines_scan", "stream_land", "stream_score", "stream_flag_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "credence.scan.partitions": cpus})       # one row group per table here
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/labels.parquet").count()     # start the JVM's readers outside the timings
    seconds = {}
    for name in names:
        start = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
