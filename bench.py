"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillstone.plans import registry
from quillstone.session import session

HEADLINE = [
    "feature_auc", "row_aggregates_v1", "row_aggregates_v2", "column_describe_orders", "pearson_pairs", "coord_llr_orders", "coord_llr_monotonic",
    "pairwise_sqeuclidean_topk", "knn_class_features", "additive_kernel", "rank_blend", "paired_deltas", "gaussian_features_oof", "svc_oof", "forest_scores", "final_rank_blend",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["column_range"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
