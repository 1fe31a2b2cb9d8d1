"""Time the headline queries, each the median of three runs after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tallymark import session
from workload.queries import QUERIES

HEADLINE = [
    "bench_compare_li",
    "bench_agreement_li",
    "bench_consensus_li",
    "compare_metrics",
    "compare_keeping_suffixes",
    "compare_run_summary",
    "discrepancies",
    "pairwise_agreement",
    "all_sets_agreement",
    "consensus_majority",
    "metrics_mean_std",
    "unique_scans",
    "stratified_sample",
    "label_prevalence",
    "format_examples",
    "report_hash",
    "prompt_messages",
    "parse_responses",
    "estimate_cost",
    "combine_meta",
    "label_reports_multi",
    "label_reports_single",
    "run_totals",
    "call_log",
    "resume_match",
    "resume_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(2 * int(cpus)),
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run(HEADLINE[0])  # loads and compiles what a join and an aggregate need
    timings = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
