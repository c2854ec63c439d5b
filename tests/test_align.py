from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as A

T0 = datetime(2026, 5, 29, 4, 0)
KEYS = {"symbol": "A", "trade_date": T0.date()}


def feed(spark, ms):
    return spark.createDataFrame([{**KEYS, "ts": T0 + timedelta(milliseconds=m), "seq": i} for i, m in enumerate(ms)],
                                 "symbol string, trade_date date, ts timestamp, seq bigint")


def test_within_tolerance(spark):
    out = A.align(feed(spark, [100, 450, 900]), feed(spark, [80, 470, 915]), 1.0)
    g = out["global_metrics"].first()
    assert (g.matched_tick_count, g.matched_dom_count, g.unmatched_ratio) == (3, 3, 0.0)
    assert g.avg_alignment_distance_ms <= 50
    assert A.valid_windows(feed(spark, [100, 450, 900]), feed(spark, [80, 470, 915])).count() == 1


def test_outside_tolerance(spark):
    g = A.align(feed(spark, [100, 450, 900]), feed(spark, [80, 470, 915]), 0.001)["global_metrics"].first()
    assert (g.matched_tick_count, g.unmatched_ratio) == (0, 1.0)


def test_missing_feed(spark):
    g = A.align(feed(spark, [100]), feed(spark, []), 1.0)["global_metrics"].first()
    assert (g.total_dom_count, g.matched_tick_ratio, g.unmatched_ratio) == (0, 0.0, 1.0)
    assert A.valid_windows(feed(spark, [100]), feed(spark, [])).count() == 0


@pytest.mark.parametrize("tolerance, bucket", [(0.005, 0.01), (1.0, 1.0), (3.0, 0.5)])
def test_nearest_matches_merge_asof(spark, tolerance, bucket):
    """Duplicated times and bucket borders included."""
    rng = np.random.default_rng(11)
    left, right = np.sort(rng.integers(0, 60_000, 400)), np.sort(rng.integers(0, 60_000, 300))
    left[10:20], right[5:12] = left[10], right[5]
    got = A.match_feeds(feed(spark, left.tolist()), feed(spark, right.tolist()), tolerance, bucket_s=bucket)
    stamp = lambda a: pd.DataFrame({"ts": pd.to_datetime(T0) + pd.to_timedelta(a, "ms"), "i": range(len(a))})
    for side, a, b in (("tick", left, right), ("dom", right, left)):
        want = pd.merge_asof(stamp(a), stamp(b).rename(columns={"i": "j"}), on="ts", direction="nearest",
                             tolerance=pd.Timedelta(seconds=tolerance))
        rows = {r.row_id: r.match_id for r in got.where(f"side = '{side}'").collect()}
        assert len(rows) == len(a)
        assert [rows[i] for i in range(len(a))] == [None if pd.isna(j) else int(j) for j in want["j"]]


def test_scores(spark):
    m = A.window_scores(A.align(feed(spark, [100, 40_000]), feed(spark, [80]), 1.0)["window_metrics"]).first()
    assert not m.window_valid and "low_data_completeness" in m.failure_reason


def test_tasks_grow_with_the_feeds(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    rng = np.random.default_rng(5)
    left, right = (np.sort(rng.integers(0, 6_000_000, 1_000)).tolist() for _ in range(2))
    found = A.match_feeds(feed(spark, left), feed(spark, right), 1.0)
    held = found.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    assert held.sum() == 2_000 and len(held) > 10 and held.max() < 500


def test_rows_are_dealt_with_one_long_for_their_bucket(spark, monkeypatch):
    """A decimal in each row would take three times the bytes of a long in the sort before the shuffle."""
    monkeypatch.setattr(A, "TASK_ROWS", 2)
    found = A.match_feeds(feed(spark, [100, 59_950, 60_020, 61_000]), feed(spark, [80, 60_010, 60_990]), 1.0)
    dealt = [line for line in found._jdf.queryExecution().analyzed().toString().splitlines() if "Generate explode" in line]
    assert len(dealt) == 1 and "BIGINT" in dealt[0].upper()
    assert "home#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.side, r.row_id): r.match_id for r in found.collect()} == {
        ("tick", 0): 0, ("tick", 1): 1, ("tick", 2): 1, ("tick", 3): 2, ("dom", 0): 0, ("dom", 1): 2, ("dom", 2): 3}
