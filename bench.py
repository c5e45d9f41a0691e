"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

HEADLINE = (
    "relationship_scores", "transmission_summary", "simplified_summary", "window_chunks", "windows_missing", "reads_in_windows", "ranked_tips", "cross_sample_duplicates", "consensus",
    "tree_closure", "tip_distances", "parsimony_states", "pair_classification", "blacklist_report", "network_components", "most_likely_chains", "flow_proportions", "flow_posterior",
    "counts_of_trees", "cleaned_in_order", "trees_rooted", "similar_merged_a", "processed_reads",
)


#: Runs of a query, of which the median counts; fewer once they have taken so long.
RUNS, ENOUGH_S = 3, 8.0


def main() -> None:
    from cladewise.plans.queries import QUERIES
    from cladewise.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), os.environ.get("BENCH_MEMORY", "12g"))
    took = {}
    # Not timed: code that any query needs is compiled, and Python workers are there.
    for name in ("relationship_scores", "parsimony_states"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < RUNS and sum(runs) < ENOUGH_S:
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1].rstrip(".")) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
