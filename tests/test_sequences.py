"""Sequence, alert and hold rules against loops over random bars."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import alerts as A
from tidemark.operators import holds as H
from tidemark.operators import sequences as Q

T0 = datetime(2026, 5, 29, 4, 0)


def random_bars(groups=12, n=60, seed=1, step=5):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.006, n)))
        for i in range(n):
            rows.append({"symbol": f"S{g}", "trade_date": T0.date(), "ts": T0 + timedelta(minutes=step * i), "ltp": float(price[i]),
                         "open_price": float(price[i]), "close_price": float(price[i]), "delta_1m": float(rng.integers(-50, 50)),
                         "roc_3": float((price[i] / price[i - 3] - 1) * 100 if i >= 3 else 0.0),
                         "roc_9": float((price[i] / price[i - 9] - 1) * 100) if i >= 9 else None,
                         "prob_long": float(rng.random() * 0.3), "prob_short": float(rng.random() * 0.3),
                         "volume_1m": int(rng.integers(0, 50)), "vwap_1m": float(price[i])})
    return pd.DataFrame(rows)


def clock(ts):
    return (ts + timedelta(minutes=330)).strftime("%H:%M:%S")


def walk(bars, theta, sign):
    """The sequence one bar at a time."""
    stage, marks = 0, []
    for i, r in enumerate(bars.itertuples()):
        prob = r.prob_long if sign > 0 else r.prob_short
        ok = (prob >= theta, sign * r.roc_3 >= 1, sign * r.roc_3 < 1, sign * r.roc_3 >= 1)[stage]
        if ok:
            marks.append(i)
            stage += 1
            if stage == 4:
                break
    return marks


def test_sequences_match_walk(spark):
    pdf = random_bars()
    out = Q.sequence_trades(spark.createDataFrame(pdf), Q.pair_table(spark, ["L28_S25"])).toPandas()
    assert len(out) == 24
    reasons = ["NO_ALERT", "MARK1_NEVER", "BETWEEN_NEVER", "MARK2_NEVER"]
    for r in out.itertuples():
        bars = pdf[pdf.symbol == r.symbol].reset_index(drop=True)
        sign = 1 if r.direction == "LONG" else -1
        marks = walk(bars, 0.28 if sign > 0 else 0.25, sign)
        times = [clock(bars.ts[i]) for i in marks] + [None] * (4 - len(marks))
        assert [r.theta_caught_time, r.mark1_ts, r.between_ts, r.entry_time_ist] == times
        if len(marks) < 4:
            assert r.rejection_reason == reasons[len(marks)]
            continue
        i, entry = marks[3], bars.ltp[marks[3]]
        if clock(bars.ts[i]) >= "15:00:00":
            assert r.rejection_reason == "CUTOFF_REJECTED_15:00" and pd.isna(r.eod_pnl_pct)
            continue
        late = [k for k in range(i, len(bars)) if clock(bars.ts[k]) >= "15:00:00"]
        out_i = late[0] if late else len(bars) - 1
        held = bars.ltp[i:out_i + 1]
        mfe = (held.max() - entry) / entry if sign > 0 else (entry - held.min()) / entry
        pnl = 0.10 if mfe >= 0.10 else sign * (bars.ltp[out_i] - entry) / entry
        assert r.mfe_pct == pytest.approx(mfe) and r.eod_pnl_pct == pytest.approx(pnl)
        passed = sign * (entry - bars.open_price[0]) > 0
        bypass = sign > 0 and not passed and bars.prob_long[i] >= 0.35
        assert r.rejection_reason == ("EXECUTED" if passed or bypass else "DAILY_OPEN_FAILED")
    assert {"EXECUTED"} <= set(out.rejection_reason)


def loop_alerts(bars, expiry, trend):
    armed, latest, out = None, -1, []
    value = volume = 0.0
    for t, r in enumerate(bars.itertuples()):
        value, volume = value + r.vwap_1m * r.volume_1m, volume + r.volume_1m
        level = {"none": None, "open": bars.ltp[0], "vwap": value / volume if volume > 0 else bars.ltp[0]}[trend]
        if r.pred != "NO_TRADE":
            armed, latest = r.pred, t
        if armed and t - latest > expiry:
            armed = None
        if armed:
            sign = 1 if armed == "LONG" else -1
            if sign * r.roc_9 >= 1.0 and (level is None or sign * (r.ltp - level) > 0):
                out.append((r.ts, armed))
                armed = None
    return out


@pytest.mark.parametrize("trend", ["none", "open", "vwap"])
def test_alerts_match_loop(spark, trend):
    pdf = random_bars(seed=2)
    df = spark.createDataFrame(pdf).withColumn("pred", A.classify(0.27))
    pdf["pred"] = [("LONG" if r.prob_long >= 0.27 and r.prob_long > r.prob_short else
                    "SHORT" if r.prob_short >= 0.27 and r.prob_short > r.prob_long else "NO_TRADE") for r in pdf.itertuples()]
    got = {(r.symbol, r.ts, r.direction) for r in A.alert_trades(df, trend=trend, expiry=7).collect()}
    want = {(s, *t) for s in pdf.symbol.unique() for t in loop_alerts(pdf[pdf.symbol == s].reset_index(drop=True), 7, trend)}
    assert got == want and len(want) > 10


def test_open_filter(spark):
    rows = lambda last: [{"symbol": "A", "trade_date": T0.date(), "ts": T0 + timedelta(minutes=i), "ltp": 100.0 if i < 15 else last,
                          "pred": "LONG", "roc_9": 0.0 if i < 15 else 2.0} for i in range(16)]
    assert A.alert_trades(spark.createDataFrame(rows(102.0)), trend="open").count() == 1
    assert A.alert_trades(spark.createDataFrame(rows(98.0)), trend="open").count() == 0


def loop_holds(price, side, move, hold, expiry):
    out, until, armed, since = [], -1, 0, -1
    for t in range(9, len(price)):
        if armed and t - since > expiry:
            armed = 0
        if t > until and side[t]:
            armed, since = side[t], t
        if t > until and armed and move[t] * armed >= 0.01:
            until, armed = min(t + hold, len(price) - 1), 0
            out.append((t, until))
    return out


def test_holds_match_loop(spark):
    pdf = random_bars(seed=3)
    df = spark.createDataFrame(pdf).withColumn("pred", A.classify(0.27))
    got = H.hold_trades(df, strategies=("model_roc",), horizons=(5,), expiries=(4,)).toPandas()
    total = 0
    for s, bars in pdf.groupby("symbol"):
        bars = bars.reset_index(drop=True)
        side = [1 if r.prob_long >= 0.27 and r.prob_long > r.prob_short else -1 if r.prob_short >= 0.27 and r.prob_short > r.prob_long else 0
                for r in bars.itertuples()]
        want = loop_holds(bars.ltp.to_numpy(), side, bars.ltp.pct_change(9).fillna(0).to_numpy(), 5, 4)
        mine = got[got.symbol == s].sort_values("entry_ts")
        assert list(zip(mine.entry_ts, mine.exit_ts)) == [(bars.ts[a], bars.ts[b]) for a, b in want]
        total += len(want)
    assert total > 5


def test_gate_trace(spark):
    pdf = random_bars(4, seed=4)
    rows = H.gate_trace(spark.createDataFrame(pdf), theta=0.29, expiry=5).toPandas()
    fired = rows[rows.event.str.startswith("TRIGGER")]
    assert set(rows.symbol) == set(pdf.symbol) and fired.groupby("symbol").size().max() <= 1
    never = H.gate_trace(spark.createDataFrame(pdf), theta=0.9).toPandas()
    assert set(never.event) == {"NEVER_REACHED_THETA"} and len(never) == 4
