"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once cold and then timed warm (median of three; once if the cold run took over ``LONG_S`` seconds).  The noop sink
computes every row and column without collecting them.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.catalog import QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = [
    "null_profile", "exact_dups", "key_profile", "value_counts", "numeric_profile", "distribution", "identity_product",
    "coverage_sets", "flatten_json", "text_length_stats", "secret_scan", "join_validated", "join_hot_keys", "merge_prior", "reconcile",
    "multiset_diff", "table_digest", "proxies", "qcut", "first_per_group", "group_folds", "random_splits", "oof_mean", "metrics",
    "error_slices", "paired_effect", "cluster_bootstrap", "corr_spearman", "gates_coverage", "oof_linear",
]


LONG_S = 15


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds, scans, shuffles = {}, {}, {}
    for name in names:
        runs = []
        cold = 0.0
        for i in range(4):
            if i > 1 and cold > LONG_S:
                break
            start = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
            else:
                cold = time.perf_counter() - start
        plan = df._jdf.queryExecution().executedPlan().toString()
        seconds[name] = round(statistics.median(runs), 3)
        scans[name] = len(re.findall(r"FileScan", plan))
        shuffles[name] = len(re.findall(r"\bExchange (?:hash|range|Single|Round)", plan))
    print(json.dumps({"metric": "total warm seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "scans": scans, "shuffles": shuffles, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
