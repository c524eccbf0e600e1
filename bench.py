"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wrenchbook.plans.registry import all_queries  # noqa: E402
from wrenchbook.session import local_session  # noqa: E402

HEADLINE = (
    "tenant_scope", "effective_context", "order_lookup", "order_search_page", "rework_chain", "message_answers",
    "legacy_split", "work_order_view", "quality_view", "rectification_view",
    "q01_orders_per_status", "q03_busiest_project", "q05_overdue_orders", "q06_newest_orders", "q09_failed_orders",
    "q10_pass_rate_per_project", "q11_most_high_findings", "spec_join_quality", "guarded_rows", "query_screening",
    "document_chunks", "markdown_sections", "document_versions", "active_chunks", "hash_vectors",
    "bm25_terms", "bm25_search", "vector_search", "rank_fusion", "policy_citations",
    "rule_findings", "model_output_checks", "inspection_results", "assembled_results", "rework_orders",
    "claimable_jobs", "replayed_events", "assignment_intervals", "applied_commands", "request_classes",
    "command_previews", "proposal_decisions", "case_recall", "reconciliation", "text_scan",
    "replay_stream", "outbox_intake_stream",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    registered = all_queries()
    names = list(registered) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # One throw-away run pays for class loading and Python workers.
    registered["q01_orders_per_status"].run(spark, directory).collect()
    registered["document_chunks"].run(spark, directory).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        registered[name].run(spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
