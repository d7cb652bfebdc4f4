"""Runs the headline queries and prints one JSON line: seconds each, and their sum."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
HEADLINE = ["family_sizes_identity", "template_filter", "mark_duplicates", "dedup_metrics", "duplication_ladder", "umi_correction_metrics", "group_identity", "group_adjacency", "group_paired", "simplex_consensus", "duplex_consensus", "zipper", "sort_template_coordinate", "duplex_yield", "compare_molecules"]


def main() -> None:
    from molframe import catalog
    from molframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    found[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        start = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
