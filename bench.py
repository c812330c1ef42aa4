"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once cold and $BENCH_WARM times warm; the figures are the medians of the warm runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from slotvalue.plans.queries import QUERIES  # noqa: E402
from slotvalue.runtime import CLUSTER_CONF, drop_scratch  # noqa: E402

HEADLINE = [
    "keep_ditch",
    "rank_by_slot",
    "session_summary",
    "resolve_identity",
    "link_projection",
    "effective_value_avg",
    "evidence_fusion",
    "majority_vote",
    "topk_match",
    "name_match_fuzzy",
    "exact_dups",
    "near_dup_clusters",
    "class_vocab",
    "balanced_queue",
    "correction_samples",
    "word_to_box",
    "manifest_drift",
    "set_fingerprint",
    "stream_current_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("slotvalue-bench")
    conf = {
        **CLUSTER_CONF,
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "shared"),
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed run loads the classes and compiles the hot code.
    QUERIES["session_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    cold, seconds = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(1 + int(os.environ.get("BENCH_WARM", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        cold[name], seconds[name] = runs[0], round(statistics.median(runs[1:] or runs), 3)
        drop_scratch(spark)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    result = {
        "metric": "slotvalue headline queries, total of warm medians",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "cold": cold,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
