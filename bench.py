"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "final_chunks", "split_long_blocks", "postings", "sparse_top_k", "dense_top_k", "similar_to_existing", "hybrid_search", "pruned_similar", "chunk_sparse_search",
    "sub_queries", "parse_interfaces", "parse_ospf_peers", "snapshot_assembly", "expected_vlans", "vlan_gap",
    "device_alerts", "device_tree", "load_trend_sliding", "last_status",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from wiretally.plans import catalog
    from wiretally.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("corpus_totals")                       # start the executors and the Python workers
    run("batch_embedding")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
