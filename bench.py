"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 3) set
the data, the cores and the timed runs; ``--all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakemoor import build_session  # noqa: E402
from lakemoor.plans import QUERIES, run  # noqa: E402

HEADLINE = (
    "star_revenue", "join_star", "grouped_sums", "having_and_filter", "count_distinct", "quantiles_exact",
    "filter_predicates", "project_expressions", "join_inner", "join_full", "join_semi", "join_interval",
    "join_asof", "join_strategies", "ranks_per_customer", "neighbours_per_user", "running_sums",
    "trailing_day", "largest_orders", "above_brand_average", "bounded_rows", "plain_events", "elided_cells",
    "widths_of_columns", "probe_tables", "document_strings", "upsert_balances", "words_of_texts",
    "stream_tumbling", "stream_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    keys = sorted(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = build_session(
        "lakemoor-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lakemoor-bench-"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="lakemoor-bench-warehouse-"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for key in keys:
        timed = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            run(key, spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt > 0:  # the first run warms up
                timed.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(timed), 3)
    spark.stop()
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "runs": runs,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
