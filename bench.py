"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Each query runs whole, into a sink that
reads every column of every row; one untimed run of the first query warms the engine.
"""

import json
import os
import time

from codeloom.queries import registry
from codeloom.session import local_session

HEADLINE = [
    "node_degrees", "edge_breakdown", "folder_rollup", "folder_edges", "verb_groups", "relation_summaries",
    "flow_trace_events", "flow_trace_trade", "layers", "parameters", "resolved_types", "line_owners",
    "symbol_bodies", "call_edges", "code_graph_edges", "semantic_profiles", "cleaned_source", "document_slices",
    "page_calls", "file_sources", "violations", "code_graph_nodes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "codeloom-bench")
    queries = registry()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(HEADLINE[0])
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
