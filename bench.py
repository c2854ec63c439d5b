"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_book", "infer_trades", "book_bars", "ohlc_bars", "bars_with_trades", "large_trade_flag", "lineitem_trade_bars",
    "asof_nearest", "valid_windows", "feature_matrix", "label_matrix", "double_momentum_exits", "alert_trigger_detail",
    "hold_alert_roc", "event_study", "excursion_profile", "control_lift", "decile_table", "average_precision",
    "oof_lr", "oof_rf", "oof_gbt", "stream_features",
]


def main() -> None:
    from tidemark import get_session
    from tidemark.catalog import entries

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        # small inputs: keep all cores busy instead of merging partitions down to one
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256kb",
        "spark.sql.codegen.cache.maxEntries": "2000"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = entries.queries()
    wanted = sys.argv[1:] or HEADLINE
    queries["book_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers and classes
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
