"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "pattern_orders_by_nation", "expand_edge_filter", "trail_uniqueness", "variable_length", "optional_match", "exists_pattern", "with_having", "aggregates", "percentiles_and_spread",
    "order_topn", "snb_style_top_parts", "finbench_style_chain", "series_aggregates", "series_window", "vector_knn", "algo_pagerank", "algo_wcc", "algo_triangles", "algo_bfs", "algo_lpa",
]


def main() -> None:
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"
    from pyspark.sql import SparkSession

    from loomgraph.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = queries(), {}
    for name in HEADLINE:
        start = time.time()
        try:
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        except Exception as e:
            print(f"{name}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
