"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from sturdytab.queries import QUERIES
from sturdytab.session import build_session

HEADLINE = [
    "audit_orders", "audit_lineitem", "audit_fractions_events", "impurities", "meta_features_lineitem",
    "column_profile_lineitem", "conflict_rows_part", "corrupt_missing_10", "corrupt_missing_levels",
    "corrupt_duplicates_with_replacement", "corrupt_label_noise_orders", "corrupt_outliers_quartile",
    "corrupt_imbalance_5to1", "corrupt_missing_noise_duplicates", "corrupt_keyless_documents", "corruption_check",
    "split_groups_events_user", "split_holdout_orders", "split_folds_orders", "subset_orders", "prepared_orders",
    "macro_scores_events", "profile_models", "selector_per_seed", "selector_strategies", "selector_leave_one_out",
    "train_clean",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__driver__memory="6g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["class_facts_orders"](spark, sf_dir).collect()  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        start = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
