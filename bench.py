"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from packetloom.catalog import QUERIES
from packetloom.session import build_session

HEADLINE = [
    "protocol_observations",
    "conversation_profiles",
    "coverage",
    "content_table",
    "byte_budget_prefix",
    "pair_transactions",
    "transactions_page",
    "query_parameters",
    "sql_signals",
    "injection_findings",
    "timeline_page",
    "scan_known",
    "scan_unknown",
    "decode_chain",
    "signature_census",
    "merge_candidates",
    "reassembled_spans",
    "stream_status",
    "contributing_frames",
    "unwrap_seq",
    "reassemble_blocks",
    "segment_records",
    "dns_score",
    "icmp_oracle",
    "key_edges",
    "webshell_events",
    "assign_asof",
    "fifo_pair",
    "echo_links",
    "merge_queue",
    "queue_page",
    "report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    # One untimed run starts the executor's code paths.
    QUERIES["protocol_observations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
