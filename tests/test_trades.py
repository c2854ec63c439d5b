"""Trade inference on hand-made snapshots, and against a plain loop on random books."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators.trades import infer_trades

T0 = datetime(2026, 5, 29, 4, 0)


def snapshot(no, depth=20, ltp=100.0, symbol="AAA", ts=None, **changes):
    row = {"symbol": symbol, "trade_date": T0.date(), "ts": ts or T0 + timedelta(microseconds=100 * no), "seq": no, "ltp": ltp}
    for i in range(1, depth + 1):
        row |= {f"bid{i}": round(100 - 0.1 * i, 1), f"ask{i}": round(100 + 0.1 * i, 1), f"bqty{i}": 100, f"aqty{i}": 100}
    return row | changes


def trades_of(spark, rows, chunk="1 hour"):
    out = infer_trades(spark.createDataFrame(rows), chunk=chunk).orderBy("symbol", "ts", "seq", "priority", "level_idx", "direction")
    return [(r.trade_price, r.trade_qty, r.direction) for r in out.collect()]


@pytest.mark.parametrize("change, expected", [
    ({}, []),
    ({"aqty1": 70}, [(100.1, 30, "BUY")]),
    ({"bqty1": 60}, [(99.9, 40, "SELL")]),
    ({"ask1": 100.3, "aqty1": 80}, [(100.1, 100, "BUY"), (100.2, 100, "BUY"), (100.3, 20, "BUY")]),
    ({"bid1": 99.7, "bqty1": 90}, [(99.9, 100, "SELL"), (99.8, 100, "SELL"), (99.7, 10, "SELL")]),
    ({"ltp": 100.2}, [(100.2, 1, "BUY")]),
    ({"ltp": 99.8}, [(99.8, 1, "SELL")]),
])
def test_rules(spark, change, expected):
    assert trades_of(spark, [snapshot(0), snapshot(1, **change)]) == expected


def test_empty_ask_before(spark):
    assert trades_of(spark, [snapshot(0, ask1=0.0), snapshot(1)]) == []


def test_single_snapshot(spark):
    assert trades_of(spark, [snapshot(0)]) == []


def loop_trades(rows, depth):
    """The rules one snapshot at a time."""
    out, by_ts = [], {}
    for prev, now in zip(rows, rows[1:]):
        found = []
        for px, qty, side, sign in (("ask", "aqty", "BUY", 1), ("bid", "bqty", "SELL", -1)):
            best, was = now[f"{px}1"], prev[f"{px}1"]
            if was > 0 and sign * best > sign * was:
                for i in range(1, depth + 1):
                    p, q = prev[f"{px}{i}"], prev[f"{qty}{i}"]
                    if sign * p < sign * best and p > 0 and q > 0:
                        found.append((p, q, side, 1, i))
                    elif p == best and q > now[f"{qty}1"]:
                        found.append((best, q - now[f"{qty}1"], side, 2, i))
            elif was > 0 and best == was and prev[f"{qty}1"] > now[f"{qty}1"]:
                found.append((was, prev[f"{qty}1"] - now[f"{qty}1"], side, 1, 1))
        by_ts.setdefault(now["ts"], []).append((prev, now, found))
    for ts, steps in by_ts.items():
        quiet = not any(f for _, _, f in steps)
        for prev, now, found in steps:
            if quiet and now["ltp"] != prev["ltp"] and now["ltp"] > 0:
                mid = (prev["ask1"] + prev["bid1"]) / 2
                buy = now["ltp"] >= mid if prev["ask1"] > 0 and prev["bid1"] > 0 else True
                found = [(now["ltp"], 1, "BUY" if buy else "SELL", 3, 1)]
            out += [(now["symbol"], ts, now["seq"], *f) for f in found]
    return sorted(out)


@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "1 day"])
def test_chunks_match_loop(spark, chunk):
    """Repeated times, time gaps over several chunks, and zero prices; chunking must not matter."""
    rng = random.Random(7)
    rows, ts = [], T0
    for symbol in ("AAA", "BBB"):
        for no in range(300):
            ts += timedelta(seconds=rng.choice([0, 0, 1, 1, 40, 90]))
            mid = rng.choice([100.0, 100.1, 100.2])
            row = snapshot(no, 3, rng.choice([100.0, 100.0, 100.1]), symbol, ts)
            for i in (1, 2, 3):
                row |= {f"bid{i}": round(mid - 0.1 * i, 1), f"ask{i}": round(mid + 0.1 * i, 1),
                        f"bqty{i}": rng.choice([50, 100, 100]), f"aqty{i}": rng.choice([50, 100, 100])}
            if rng.random() < 0.05:
                row["ask1"] = 0.0
            rows.append(row)
    want = [t for s in ("AAA", "BBB") for t in loop_trades([r for r in rows if r["symbol"] == s], 3)]
    got = infer_trades(spark.createDataFrame(rows), chunk=chunk).collect()
    assert sorted((r.symbol, r.ts, r.seq, r.trade_price, r.trade_qty, r.direction, r.priority, r.level_idx) for r in got) == sorted(want)
    assert len(want) > 100
