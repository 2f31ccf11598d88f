"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_QUERIES: comma-separated names instead of the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sluice.queries import all_queries, gate_queries  # noqa: E402
from sluice.session import local_session  # noqa: E402
from sluice.sources.tables import read_table  # noqa: E402

HEADLINE = (
    "column_facts_lineitem", "column_facts_documents", "column_profile_orders", "value_counts_orders", "gate_findings",
    "gate_metrics", "release_table", "change_ledger", "release_validations", "exact_duplicates", "key_conflict_groups",
    "sensitive_scan_documents", "table_fingerprint", "mapping_grounding", "claim_verification", "event_sequence",
    "sliding_admission",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    queries = all_queries()
    # Start the JVM's compilers on another table, so the first query is not charged for them.
    queries["column_facts_customer"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in chosen:
        gate_queries.RUNS.clear()  # every query runs its own gate
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rows = read_table(spark, folder, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "profiled_rows_per_sec": round(rows / seconds["column_facts_lineitem"]) if "column_facts_lineitem" in seconds else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
