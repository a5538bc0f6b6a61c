"""Times the headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from docloom.plans import queries as engine
from docloom.session import local_session

NAMES = ["normalize_docs", "sentences", "chunk_fold_semantic", "sparse_terms", "sparse_topk", "hybrid_search", "dense_topk", "registry_diff", "microbatch_events", "dense_lists", "synced_tables"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 16)
    engine.approx_tokens(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm start
    took = {}
    for name in NAMES:
        began = time.time()
        engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "master": f"local[{cpus}]", "spark": spark.version, "state": "warm"}))


if __name__ == "__main__":
    main()
