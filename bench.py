"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 1, the median is reported) set the run. Every query is run
to its last row through the no-op sink.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402

HEADLINE = (
    "load_main_drug",
    "load_main_adr",
    "fixed_width_parse",
    "union_rename",
    "describe_features",
    "standardize",
    "class_share",
    "stratified_folds_five",
    "dense_row_id",
    "disproportionality",
    "disproportionality_parts",
    "ebgm",
    "signal_scores",
    "squash",
    "neg_log_lik",
    "fit_prior",
    "enrich",
    "bh_adjust",
    "roc_auc",
    "auprc",
    "knn_within_class",
    "smote_rows",
    "gbt_scores",
    "mlp_final",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = queries()
    warm = catalogue["ebgm"](spark, sf_dir)
    warm.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            catalogue[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
