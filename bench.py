"""Times the headline queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores), ``BENCH_QUERIES``
(comma-separated names, default: the headline set).  Every result is computed in full
and thrown away, so only Spark's work counts.  The migrated states that the change
streams start from are made once and timed on their own.
"""

from __future__ import annotations

import json
import os
import time

from twinsync.checks import all_queries, common
from twinsync.session import local_session

HEADLINE = [
    "migrate_addresses", "migrate_customers", "migrate_invoices", "migrate_invoice_lines",
    "envelope_decode", "payload_typed_decode", "filter_pipeline_events", "dependency_gate", "hold_and_release",
    "topological_order", "apply_customer_to_new", "apply_invoice_to_new", "apply_line_to_new",
    "apply_customer_to_old", "apply_address_to_old", "apply_invoice_to_old", "apply_line_to_old",
    "capture_old_invoice", "capture_old_line", "list_new_customers", "list_new_invoices", "invoice_details_new",
    "address_details", "cascade_delete", "fk_violations", "reconcile_summary", "event_timeline",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    available = all_queries()
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        start = time.time()
        action()
        seconds[name] = round(time.time() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock
    timed("state_full_migration", lambda: common.full_state(spark, folder))
    timed("state_base_migration", lambda: common.base_state(spark, folder))
    timed("state_edited", lambda: common.edited_state(spark, folder))
    for name in names:
        timed(name, lambda: available[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
