"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

    python bench.py [query …]
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "load_table",
    "validate_panel",
    "split_stratified",
    "split_summary",
    "profile_missing",
    "mean_impute",
    "forward_fill",
    "mice_impute",
    "mice_impute_panel",
    "one_hot",
    "standard_scale",
    "robust_scale",
    "preprocess",
    "yeo_johnson_fit",
    "gaussian_candidates",
    "corr_matrix",
    "histogram",
    "qq_points",
    "classification_metrics",
    "auc_roc_fine",
    "roc_curve_reduced",
    "pr_curve",
    "knn_join",
    "smote",
    "edited_nn",
    "smote_enn",
    "knn_classify",
    "class_weights",
    "gaussian_nb",
    "random_forest",
    "logistic_regression",
    "boosted_trees",
    "random_search_cv",
    "train_and_select",
]


def main() -> None:
    from panelsmith.plans.catalog import QUERIES
    from panelsmith.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = get_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["knn_join"](spark, sf_dir).count()  # starts the Python workers
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
