from datetime import datetime, timedelta

import pytest

from tidemark.operators.schema import MODEL_FEATURES
from tidemark.plans.matrix import NO_TRADE_DEFAULTS, feature_matrix, labelled_matrix, raw_to_labels

T0 = datetime(2026, 5, 29, 4, 0)


@pytest.fixture(scope="module")
def feeds(spark):
    """BUSY loses ask quantity at every second snapshot; CALM never changes; LATE has a book but no ticks."""
    book, ticks = [], []
    for symbol in ("BUSY", "CALM", "LATE"):
        for no in range(60):
            ts = T0 + timedelta(seconds=10 * no)
            row = {"symbol": symbol, "trade_date": T0.date(), "ts": ts, "seq": no, "ltp": 100.0}
            for i in range(1, 6):
                row |= {f"bid{i}": 100 - 0.1 * i, f"ask{i}": 100 + 0.1 * i, f"bqty{i}": 100, f"aqty{i}": 100}
            if symbol == "BUSY":
                row["aqty1"] = 60 if no % 2 else 100
            book.append(row)
            if symbol != "LATE":
                ticks.append({"symbol": symbol, "trade_date": T0.date(), "ts": ts + timedelta(milliseconds=20), "seq": no, "ltp": 100.0, "trade_qty": 1})
    return spark.createDataFrame(book), spark.createDataFrame(ticks)


def test_matrix(feeds):
    book, ticks = feeds
    out = feature_matrix(book, ticks).orderBy("symbol", "ts").toPandas()
    assert set(out.symbol) == {"BUSY", "CALM"} and len(out) == 20
    busy, calm = out[out.symbol == "BUSY"], out[out.symbol == "CALM"]
    assert (busy.buy_vol_1m == 120).all() and (busy.trade_count_1m == 3).all() and (busy.aggressor_ratio == 1.0).all()
    assert busy.vwap_1m.to_numpy() == pytest.approx(100.1) and busy.imbalance_top5.to_numpy() == pytest.approx(20 / 980)
    for name, value in NO_TRADE_DEFAULTS.items():
        assert (calm[name] == value).all(), name
    assert calm.vwap_distance.isna().all() and not busy[MODEL_FEATURES].isna().any().any()


def test_needs_ticks(feeds):
    assert feature_matrix(feeds[0], None).count() == 0


def test_unified_feed_skips_alignment(feeds):
    book, _ = feeds
    assert feature_matrix(book, book).count() == 30


def test_labels_follow(feeds):
    book, ticks = feeds
    out = labelled_matrix(feature_matrix(book, ticks), horizons=(2,), thresholds=(0.01,)).toPandas()
    assert (out.label_2m_1pct == "NO_TRADE").sum() == 16 and out.label_2m_1pct.isna().sum() == 4


def test_raw_to_labels(feeds):
    book, ticks = feeds
    out = raw_to_labels(book, ticks)
    assert out.count() == 20 and "label_60m_3pct" in out.columns
