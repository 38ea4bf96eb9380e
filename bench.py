"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its figure is the median.
"""

import json
import os
import statistics
import time

from tablewright.catalog import all_queries
from tablewright.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = [
    "missing_by_column",
    "column_types_dirty",
    "distinct_counts",
    "value_frequencies",
    "duplicate_rows",
    "numeric_describe",
    "skew_kurtosis",
    "median_mad",
    "correlation_matrix",
    "outliers_iqr",
    "outliers_mad",
    "class_balance",
    "validation_report",
    "profile_summary",
    "impute_median",
    "normalize_categories",
    "scale_standard",
    "scale_robust",
    "onehot_encode",
    "ordinal_encode",
    "train_test_split",
    "stratified_split",
    "kfold_assign",
    "regression_metrics",
    "classification_metrics",
    "knn_classify",
    "linear_regression_1d",
    "correlation_wide",
    "stratified_split_many",
    "histogram",
    "trend_month",
    "table_fingerprint",
    "narrative_validate",
]


def run_once(query, spark):
    start = time.perf_counter()
    query.run(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = {q.name: q for q in all_queries()}
    run_once(known["schema_report"], spark)  # so that no query is charged for starting up
    times = {}
    for name in HEADLINE:
        run_once(known[name], spark)
        times[name] = round(statistics.median(run_once(known[name], spark) for _ in range(RUNS)), 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
