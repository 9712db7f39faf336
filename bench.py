"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Every query runs to its last row and is timed once, cold.
"""

from __future__ import annotations

import json
import os
import time

from tabveil.catalog import load
from tabveil.session import build_session

HEADLINES = [
    "scan_pruned", "normalize_text", "topn_other", "wrangle_intensive", "wrangle_high_fidelity", "group_size_two_keys",
    "sample_exact", "split_stratified", "pii_columns_documents", "utility_marginal", "utility_joint", "dp_efficiency",
    "label_encode_union", "weighted_f1", "singling_out_multivariate", "linkability_risk", "inference_risk",
    "three_axis_audit", "marginals_two_way_zero_cells", "synthesize", "tstr_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINES
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's workers
    times = {}
    for name in names:
        started = time.perf_counter()
        registered[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
