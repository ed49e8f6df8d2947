"""Time the headline queries; prints one JSON line.

``graph_tables`` is the one-time derivation of the graph from the warehouse tables;
the queries then run on the written tables, each with all it derives itself.
"""

from __future__ import annotations

import json
import os
import time

from faultline.catalog import QUERIES
from faultline.session import local_session
from faultline.sources import binding

HEADLINE = (
    "closure_depth6 routes blast_radius package_reach indegree_importance neighbours version_history max_satisfying "
    "bad_version safe_version hop1_gate lockfile_pins refined_closure refined_blast resolved_while_live maintainer_risk "
    "typosquat_pairs risk_profile timeline incident_report remediation_plan advisory_match apply_advisories "
    "lock_npm lock_yarn lock_pnpm ingest_report advisory_stream"
).split()


def drain(frame) -> int:
    """Run the query to the end and count its rows."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    frame.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return int(seen.get["n"])


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="faultline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm):
        drain(QUERIES["blast_radius"](spark, warm))

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    begun = time.time()
    graph = binding.graph_for(spark, sf_dir)
    times["graph_tables"] = round(time.time() - begun, 3)
    for name in HEADLINE:
        begun = time.time()
        rows[name] = drain(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - begun, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "roots": graph.roots.count(),
                "sf": os.path.basename(sf_dir),
            }
        )
    )


if __name__ == "__main__":
    main()
