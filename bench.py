"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from khata.plans import catalog  # noqa: E402
from khata.session import local_session  # noqa: E402

HEADLINES = (
    "period_summary_all", "spend_by_category", "spend_by_merchant", "daily_buckets", "coverage", "review_groups",
    "month_change", "fact_sheet", "merge_ledger_reprocess", "correct_merchants", "resolve_categories",
    "extract_transactions", "classify_inbox", "latest_bills", "dedup", "transfer_pairs", "nb_predict",
    "nb_leave_one_out", "redact", "redact_documents", "find_leaks", "mine_templates", "trace_fields",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "khata-bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds: dict[str, float] = {}
    for name in chosen:
        build = catalog.QUERIES[name]
        took = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(name, [round(t, 1) for t in took], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
