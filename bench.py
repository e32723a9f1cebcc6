"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads. Results are
computed in full and thrown away by the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from hinterland.catalogue import QUERIES  # noqa: E402

HEADLINE = [
    "pdw_mean", "pdw_mean_by_group", "measure_pipeline", "nearest_in_group",
    "nearest_large_group", "nearest_wmean",
    "rollup_prefix", "merge_two_sources", "county_wmean", "panel_left_chain", "natural_fold",
    "point_in_polygon", "first_per_key", "key_index", "group_mutate", "describe_by_year",
    "propmiss", "hist_density", "kde_curve", "group_quantiles", "group_quantiles_sorted",
    "posterior_terms", "regression_table", "margin_quad", "margin_mult", "margin_tables",
    "design_matrix", "gram_entries", "gram_wide", "ols_coef", "state_suffstats",
    "normal_draws", "vi_normal_fit", "beta_fit", "vi_beta_fit", "fit_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # Start the JVM's and the Python workers' machinery outside the timings.
    ids = spark.range(64).repartition(int(cpus), "id")
    ids.mapInArrow(lambda batches: batches, "id long").count()
    ids.groupBy("id").applyInPandas(lambda rows: rows, "id long").count()

    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
