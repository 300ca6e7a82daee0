"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs whole, model fit included; its result goes to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tagloom.catalog import QUERIES

HEADLINE = (
    "clean_text",
    "preprocess_text",
    "term_counts",
    "nb_model_terms",
    "nb_predict",
    "batch_segments",
    "top_k_segments",
    "evaluate_metrics",
    "hashed_nb_predict",
    "ovr_logreg_predict",
    "language_profiles",
    "detect_language",
    "lemmatize_vocab",
    "lookup_replace",
    "annotate_tokens",
    "segment_distribution",
    "tag_sequence",
    "lemmatize_tagged",
    "detect_language_short",
    "ingest_json_batch",
    "ingest_delimited",
    "clean_documents",
    "ingest_json_array",
    "sliding_report",
    "sliding_report_panes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tagloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # No Python call sites in error messages: building a plan takes half the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the session's threads and readers; no registered query runs before its timing.
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
