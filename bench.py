"""Times the registered headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "balances", "balances_before_cutoff", "oldest_first_allocation", "balance_ranking", "settlement_log", "balances_by_name",
    "record_derivation", "review_issues", "output_rows", "overview_kpis", "step_completion", "month_histogram", "top_reasons",
    "facet_counts", "party_index", "party_scope_counts", "packet_index", "split_by_step", "step_transitions", "catalog_diff",
    "ledger_status", "rename_inheritance", "patched_catalog", "collision_names", "near_duplicate_names", "near_duplicate_people",
    "near_duplicate_titles", "best_name_match", "document_candidates", "passage_dice", "widget_matches", "word_boxes",
    "words_minus_printed", "layout_classes", "first_addresses", "contact_import", "link_suggestions", "digest_rows",
    "attachment_pick", "announcements_batch", "announcements_stream", "debounced_bursts", "daily_counts_stream", "parsed_dates",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("caseflow-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from caseflow.plans import load_queries
    from caseflow.session import clear_scratch

    registry = load_queries()
    if names == ["all"]:
        names = list(registry)
    registry["balances"].run(spark, sf).write.mode("overwrite").format("noop").save()  # start-up is not a query
    seconds = {}
    for name in names:
        t = time.perf_counter()
        registry[name].run(spark, sf).write.mode("overwrite").format("noop").save()
        clear_scratch(spark)
        seconds[name] = round(time.perf_counter() - t, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
