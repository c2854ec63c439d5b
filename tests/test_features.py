from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators.labels import label_matrix

T0 = datetime(2026, 5, 29, 4, 0)


def flat_bars(spark, n=25, **zero_at):
    rows = [{"symbol": "A", "trade_date": T0.date(), "ts": T0 + timedelta(minutes=i), "buy_vol_1m": 100, "sell_vol_1m": 50,
             "volume_1m": 150, "trade_count_1m": 10, "large_trade_count_1m": 1, "ltp": 100.0, "vwap_1m": 100.0} for i in range(n)]
    for i in zero_at.get("rows", []):
        rows[i] |= {c: 0 for c in ("buy_vol_1m", "sell_vol_1m", "volume_1m", "trade_count_1m", "large_trade_count_1m")}
    return spark.createDataFrame(rows)


def test_flow(spark):
    rows = X.trade_flow(flat_bars(spark)).orderBy("ts").collect()
    assert [r.delta_1m for r in rows] == [50] * 25
    assert [r.delta_5m for r in rows[:6]] == [50, 100, 150, 200, 250, 250]
    assert rows[-1].volume_burst == pytest.approx(1.0)
    assert rows[-1].aggressor_ratio == pytest.approx(2 / 3)
    assert rows[-1].large_trade_ratio == pytest.approx(0.1)


def test_empty_bar(spark):
    r = X.trade_flow(flat_bars(spark, rows=[24])).orderBy(F.desc("ts")).first()
    assert (r.delta_1m, r.volume_burst, r.aggressor_ratio, r.large_trade_ratio) == (0, 0.0, 0.5, 0.0)


def test_quality_gate(spark):
    df = X.trade_flow(flat_bars(spark))
    assert all(r.passed for r in X.quality_gate(df).collect())
    broken = df.withColumn("aggressor_ratio", F.when(F.col("ts") == T0, None).otherwise(F.lit(3.0)))
    failed = {r.feature: (r.nulls, r.passed) for r in X.quality_gate(broken).collect()}
    assert failed["aggressor_ratio"] == (1, False) and failed["delta_1m"] == (0, True)


@pytest.mark.parametrize("n, span", [(40, 100), (237, 100), (1050, 100), (600, 50)])
def test_large_flag_matches_one_pass(spark, n, span):
    """Blocks with a predecessor as context equal a single pass over the whole group."""
    rng = np.random.default_rng(3)
    qty = rng.integers(1, 30, n)
    qty[rng.random(n) < 0.05] *= 40
    times = [T0 + timedelta(seconds=int(s)) for s in np.sort(rng.integers(0, 7200, n))]
    rows = pd.DataFrame({"symbol": "A", "trade_date": T0.date(), "ts": times, "seq": range(n), "trade_qty": qty})
    want, recent, limit = [], [], None
    for q in qty:
        recent = (recent + [q])[-span:]
        k = len(recent)
        if k >= 3 and (k % 5 == 0 if k <= 50 else k % 50 == 0):
            limit = 10 * np.median(recent)
        want.append(int(limit is not None and q > limit))
    got = X.large_trade_flag(spark.createDataFrame(rows), span=span, chunk="15 minutes", order=("ts", "seq"))
    assert [r.is_large for r in got.orderBy("seq").collect()] == want
    assert n < 100 or sum(want) > 0


def test_no_lookahead(spark):
    """Cutting off the future must not change earlier features."""
    rng = np.random.default_rng(5)
    base = flat_bars(spark, 60).toPandas()
    base["ltp"] = 100 + rng.normal(0, 1, 60).cumsum()
    base["buy_vol_1m"] = rng.integers(0, 200, 60)
    base["volume_1m"] = base["buy_vol_1m"] + base["sell_vol_1m"]
    cols = ["delta_5m", "volume_burst", "volatility_5m", "price_acceleration", "return_5m", "absorption_buyer_5m"]
    full = X.absorption(X.price_features(X.trade_flow(spark.createDataFrame(base)))).orderBy("ts").toPandas()
    part = X.absorption(X.price_features(X.trade_flow(spark.createDataFrame(base[:40])))).orderBy("ts").toPandas()
    pd.testing.assert_frame_equal(full.loc[:39, cols], part[cols])


def test_labels(spark):
    df = flat_bars(spark, 5).withColumn("ltp", F.when(F.minute("ts") == 1, 102.0).when(F.minute("ts") == 2, 98.0).otherwise(F.col("ltp")))
    rows = label_matrix(df, (1,), (0.01, 0.07)).orderBy("ts").collect()
    assert [r.label_1m_1pct for r in rows] == ["LONG", "SHORT", "LONG", "NO_TRADE", None]
    assert rows[0].label_1m_7pct == "NO_TRADE"
