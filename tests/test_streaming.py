"""Several files, one per micro-batch: state must carry across batches and match the batch result."""

import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.bars import bars_with_trades, book_bars, trade_bars
from tidemark.operators.compare import table_diff
from tidemark.operators.features import all_features, depth_features, large_trade_flag
from tidemark.operators.schema import MODEL_FEATURES
from tidemark.operators.trades import infer_trades
from tidemark.streaming import book as B
from tidemark.streaming import live as L

T0 = datetime(2026, 5, 29, 3, 45)


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows = []
    for s in ("AAA", "NIFTY"):
        ts, px = T0, 1000
        for no in range(400):
            ts += timedelta(seconds=int(rng.integers(2, 20)))
            px += int(rng.integers(-2, 3))
            r = {"symbol": s, "trade_date": T0.date(), "ts": ts, "seq": no, "ltp": px / 10}
            for i in range(1, 6):
                r |= {f"bid{i}": (px - i) / 10, f"ask{i}": (px + i) / 10, f"bqty{i}": int(rng.integers(10, 500)), f"aqty{i}": int(rng.integers(10, 500))}
            rows.append(r)
    pdf = pd.DataFrame(rows)
    folder = tmp_path_factory.mktemp("ticks")
    for k, part in enumerate(np.array_split(pdf.sort_values("ts").index, 4)):
        pdf.loc[part].sample(frac=1, random_state=k).to_parquet(folder / f"part{k}.parquet", coerce_timestamps="us")
    batch = spark.read.parquet(str(folder))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = tmp_path_factory.mktemp("out")
    L.run_to_table(L.live_bars(stream, "1 minute", "30 seconds"), str(out / "bars"), str(out / "ckpt"))
    return batch, spark.read.parquet(str(out / "bars")), out


def test_stream_equals_batch(spark, replay):
    batch, live, out = replay
    assert live.select("batch_id").distinct().count() >= 3
    live = live.drop("batch_id").unionByName(L.flush(spark, str(out / "ckpt"), "1 minute"))
    trades = large_trade_flag(infer_trades(batch), order=("ts", "seq", "priority", "level_idx", "direction"))
    bars = all_features(bars_with_trades(depth_features(book_bars(batch)), trade_bars(trades)))
    cols = ["symbol", "ts", "open_price", "close_price", "ltp", "buy_vol_1m", "sell_vol_1m", "trade_count_1m", "large_trade_count_1m",
            "vwap_1m", *MODEL_FEATURES]
    diff = {r.column: (r.rows, r.mismatches) for r in table_diff(live.select(*cols), bars.select(*cols), ["symbol", "ts"], rtol=1e-6, atol=1e-6).collect()}
    assert all(bad == 0 for _, bad in diff.values()), diff
    assert diff["ltp"][0] > 50


def test_signals(spark, replay):
    _, live, out = replay
    scored = lambda df: df.withColumns({"prob_long": F.lit(0.25), "prob_short": F.lit(0.0), "prob_no_trade": F.lit(0.75)})
    feed = scored(spark.readStream.schema(live.schema).parquet(str(out / "bars")))
    L.run_to_table(L.live_signals(feed), str(out / "sig"), str(out / "sig_ckpt"), transform=L.tradable)
    signals = spark.read.parquet(str(out / "sig")).toPandas()
    bars = live.where("symbol = 'AAA'").orderBy("ts").toPandas()
    stage, hit = 0, None
    for r in bars.itertuples():
        ok = (True, r.roc_3 >= 1, r.roc_3 < 1, r.roc_3 >= 1)[stage]
        stage += bool(ok)
        if stage == 4:
            hit = r
            break
    assert set(signals.symbol) <= {"AAA"} and set(signals.direction) <= {"LONG"}
    assert len(signals) == (hit is not None)
    if hit is not None:
        assert signals.entry_price[0] == pytest.approx(hit.ltp) and signals["mode"][0] == "VIRTUAL"


@pytest.mark.parametrize("span", [50, 100])
def test_large_trades_by_slices(span):
    """As trade by trade, however the trades are cut; a full span is renewed by every trade."""
    rng = np.random.default_rng(3)
    qty, recent, limit, want = rng.integers(1, 400, 700).astype(float) ** 2, [], None, []
    for q in qty:
        recent = [*recent, q][-span:]
        if len(recent) >= 3 and len(recent) % (5 if len(recent) <= 50 else 50) == 0:
            limit = 10.0 * float(np.median(recent))
        want.append(int(limit is not None and q > limit))
    for cuts in ([], [1, 2, 3, 60, 60, 333], list(range(0, 700, 7))):
        held, last, got = [], None, []
        for part in np.split(qty, cuts):
            flags, held, last = B.flag_large(part, held, last, span)
            got += flags.tolist()
        assert got == want and held == recent and last == limit


def test_a_full_span_of_trades_takes_no_median_each():
    qty = np.random.default_rng(4).integers(1, 400, 200_000).astype(float)
    start = time.process_time()
    B.flag_large(qty, [], None)
    assert time.process_time() - start < 5  # a median of the span for each trade takes minutes


def test_open_snapshots_are_kept_whole():
    rows = pd.DataFrame({c: np.arange(5) / 3 for c in B.SNAPSHOT}).assign(ts=[2**61 + i for i in range(5)], seq=[2**60 + 1] * 5)
    rows.loc[2, "bid3"] = np.nan
    pd.testing.assert_frame_equal(B.snapshots(B.packed(rows)), rows)
    assert B.packed(rows.iloc[:0]) == b"" and list(B.snapshots(b"").columns) == B.SNAPSHOT
