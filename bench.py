"""Headline queries, timed; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.runtime import local_session
from plumbline.showcase import registry

HEADLINE = (
    "g2_rank_lines", "g2_rank_against_reference", "g3_control_test", "g4_annotate_targets",
    "d1_empirical_cdf", "d7_shuffle_outcome", "d6_ensemble_stats", "d31_radius_of_gyration",
    "f4_dinucleotide_shuffles", "g1_ingest_candidates", "c10_interface_contacts", "d12_pocket_geometry",
    "d19_bootstrap_auc", "g11_discrimination_scores", "h1_run_status", "d25_group_quartiles",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # The first Python worker and the first generated classes are not the queries' cost.
    queries["d1_empirical_cdf"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
