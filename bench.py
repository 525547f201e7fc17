"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully materialised with a no-op write (``format("noop")``), so the whole
plan runs without moving rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from archspark.plans.queries import REGISTRY  # noqa: E402
from archspark.session import build_session  # noqa: E402

HEADLINE = [
    "commit_frequency", "file_history", "latest_commits", "cochange_raw", "temporal_matrix",
    "windowed_temporal_matrix", "import_resolution", "fan_in_out", "import_cycles", "dependency_depth",
    "supplier_cycles", "blast_radius", "global_impact", "companion_files", "layer_argmax", "label_propagation",
    "file_fact_enrichment", "health_scores", "missing_tests", "risk_union", "code_facts",
    "intent_concepts", "candidate_topk", "first_keyword_match", "agent_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # names as arguments; --all: every query of the analysis; none: the headline set of all rounds
    names = list(REGISTRY) if sys.argv[1:] == ["--all"] else sys.argv[1:] or [n for n in HEADLINE if n in REGISTRY]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="archspark-bench")
    # warm-up (not timed): JVM start, Parquet footer reads and code paths used by every query
    spark.read.parquet(os.path.join(sf_dir, "orders.parquet")).select("o_orderkey").limit(1000).count()
    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - a failed query is reported, never hidden
            times[name] = None
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
