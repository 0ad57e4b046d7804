"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from furrow.catalog import all_queries
from furrow.session import local_session

HEADLINE = [
    "multivalue_long",
    "crosstab_counts",
    "cumulative_by_year",
    "cumulative_cross_cutting",
    "pct_of_year",
    "top_n_ties",
    "pooled_pct_with_total",
    "share_of_total",
    "weighted_quantile",
    "mode_first",
    "median_strict",
    "small_scale_class",
    "scenario_sensitivity",
    "regrid_nearest",
    "regrid_bilinear",
    "rasterize_polygons",
    "stack_layers",
    "clean_corpus",
    "tfidf_top_terms",
    "nb_cross_validated",
    "nb_grid_search",
    "metrics_table",
    "review_matrix",
    "review_themes",
    "review_needs",
    "quantile_threshold_flag",
    "rain_composite",
    "farm_summary",
    "join_year_and_sort",
    "kfold_contiguous",
    "svm_rff",
    "mlp_text",
    "forest_text",
    "batch_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark, catalog, times = local_session("furrow-bench", cores), all_queries(), {}
    # start the executors and the parquet reader before the first clock
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    for name in names:
        runs = []
        for _ in range(repeats):
            begin = time.perf_counter()
            catalog[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        times[name] = round(median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
