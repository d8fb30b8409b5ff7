"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds a query (one warm-up, then the median of three)."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = (
    "scan_region", "project_expr_lineitem", "filter_range_and", "in_subquery", "scalar_subquery_avg", "join_inner", "join_three_way", "agg_global", "group_two_keys", "having_alias", "quantile_by_group", "ntile_partitioned", "win_sum_partition",
    "order_multi", "topk", "limit_offset", "view_chained", "dq_checks", "stream_windows", "star_join_group_having_order",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from larkmill.plans.registry import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        out[name] = round(median(took[1:]), 4)
    print(json.dumps({"metric": "sum of medians over headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
