"""Per-key helpers of the live path: trades, bars and features of one symbol-day slice.

Spark partitions, shuffles and keeps the state; these functions see the rows of one key in one
micro-batch plus a bounded history (one snapshot, the open bar, twenty bars).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from tidemark.operators.schema import FEATURE_DEPTH, MODEL_FEATURES, levels

DEPTH = FEATURE_DEPTH
LEVELS = [c for s in ("bid", "bqty", "ask", "aqty") for c in levels(s, DEPTH)]
SNAPSHOT = ["ts", "seq", "ltp", *LEVELS]
SUMS = ["buy_vol_1m", "sell_vol_1m", "volume_1m", "trade_count_1m", "large_trade_count_1m"]
BAR = ["ts", "open_price", "high_price", "low_price", "close_price", "ltp", *LEVELS, *SUMS, "vwap_1m"]
HISTORY = 20


def find_trades(rows: pd.DataFrame) -> pd.DataFrame:
    """Trades between consecutive snapshots of ``rows`` (sorted): row, price, qty, buy, priority, level."""
    found = []
    for buy, px, qty in ((True, "ask", "aqty"), (False, "bid", "bqty")):
        p, q = rows[levels(px, DEPTH)].to_numpy(float), rows[levels(qty, DEPTH)].to_numpy(float)
        was, had, best, left = p[:-1], q[:-1], p[1:, :1], q[1:, :1]
        sign = 1.0 if buy else -1.0
        moved = (was[:, :1] > 0) & (sign * best > sign * was[:, :1])
        swept = moved & (sign * was < sign * best) & (was > 0) & (had > 0)
        part = moved & (was == best) & (had > left)
        held = (was[:, 0] > 0) & (best[:, 0] == was[:, 0]) & (had[:, 0] > left[:, 0])
        for hit, volume, priority in ((swept, had, 1), (part, had - left, 2)):
            r, level = np.nonzero(hit)
            found.append((r + 1, was[r, level], volume[r, level], buy, priority, level + 1))
        r = np.flatnonzero(held)
        found.append((r + 1, was[r, 0], (had - left)[r, 0], buy, 1, np.ones(len(r), int)))
    found.append(_price_moves(rows, np.concatenate([f[0] for f in found])))
    out = pd.concat([pd.DataFrame({"row": r, "price": p, "qty": v, "buy": b, "priority": k, "level": lv})
                     for r, p, v, b, k, lv in found if len(r)] or
                    [pd.DataFrame(columns=["row", "price", "qty", "buy", "priority", "level"], dtype=float)])
    return out.sort_values(["row", "priority", "level", "buy"], ascending=[True, True, True, False], kind="stable")


def _price_moves(rows: pd.DataFrame, traded: np.ndarray):
    ts, ltp = rows["ts"].to_numpy(), rows["ltp"].to_numpy(float)
    ask, bid = rows["ask1"].to_numpy(float)[:-1], rows["bid1"].to_numpy(float)[:-1]
    quiet = ~np.isin(ts[1:], ts[traded])
    r = np.flatnonzero(quiet & (ltp[1:] != ltp[:-1]) & (ltp[1:] > 0) & ~np.isnan(ltp[:-1]))
    buy = ~((ask[r] > 0) & (bid[r] > 0)) | (ltp[r + 1] >= (ask[r] + bid[r]) / 2.0)
    return r + 1, ltp[r + 1], np.ones(len(r)), buy, 3, np.ones(len(r), int)


def flag_large(qty: np.ndarray, recent: list[float], limit: float | None, span: int = 10_000):
    """Running-median flag of new trades given the recent quantities; returns flags, recent, limit."""
    values = np.concatenate([np.asarray(recent, float), np.asarray(qty, float)])
    n = np.minimum(np.arange(len(recent) + 1, len(values) + 1), span)
    renewed = (n >= 3) & (n % np.where(n <= 50, 5, 50) == 0)  # a full span is renewed by every trade
    limits = np.full(len(n) + 1, np.nan)
    limits[0] = np.nan if limit is None else limit
    if renewed.any():
        limits[1:][renewed] = 10.0 * pd.Series(values).rolling(span, min_periods=1).median().to_numpy()[len(recent):][renewed]
    limits = pd.Series(limits).ffill().to_numpy()
    last = None if np.isnan(limits[-1]) else float(limits[-1])
    return (values[len(recent):] > limits[1:]).astype(int), values[-span:].tolist(), last


def packed(rows: pd.DataFrame) -> bytes:
    """Snapshots as state keeps them: times and sequence numbers, then all other columns as doubles."""
    return rows[SNAPSHOT[:2]].to_numpy("int64").tobytes() + rows[SNAPSHOT[2:]].to_numpy("float64").tobytes()


def snapshots(data: bytes) -> pd.DataFrame:
    """The rows of ``packed``."""
    n = len(data) // (8 * len(SNAPSHOT))
    whole = np.frombuffer(data, np.int64, 2 * n).reshape(n, 2)
    rest = np.frombuffer(data, np.float64, offset=16 * n).reshape(n, len(SNAPSHOT) - 2)
    return pd.concat([pd.DataFrame(whole, columns=SNAPSHOT[:2]), pd.DataFrame(rest, columns=SNAPSHOT[2:])], axis=1)


def make_bars(rows: pd.DataFrame, trades: pd.DataFrame, width_us: int) -> pd.DataFrame:
    """Bars of complete minutes: prices and mean levels from rows, flows from their trades."""
    start = rows["ts"] - rows["ts"] % width_us
    g = rows.groupby(start)
    price = g["ltp"]
    # plain sums in row order, as the batch aggregate takes them: the features compare level means
    at = g.ngroup().to_numpy()
    bars = pd.DataFrame({c: np.bincount(at, weights=rows[c].to_numpy(float)) for c in LEVELS},
                        index=price.first().index).div(price.size(), axis=0)
    bars = bars.assign(open_price=price.first(), high_price=price.max(), low_price=price.min(),
                       close_price=price.last(), ltp=price.mean())
    t = trades.assign(bar=start.loc[trades["row"]].to_numpy(), value=trades["price"] * trades["qty"],
                      bought=trades["qty"].where(trades["buy"].astype(bool), 0.0))
    s = t.groupby("bar").agg(buy_vol_1m=("bought", "sum"), volume_1m=("qty", "sum"), trade_count_1m=("qty", "count"),
                             large_trade_count_1m=("is_large", "sum"), value=("value", "sum"))
    bars = bars.join(s).fillna({c: 0 for c in s.columns})
    bars["sell_vol_1m"] = bars["volume_1m"] - bars["buy_vol_1m"]
    bars["vwap_1m"] = (bars["value"] / bars["volume_1m"].where(bars["volume_1m"] > 0)).fillna(0.0)
    return bars.rename_axis("ts").reset_index()[BAR]


def _over(a, b, default=0.0):
    return (a / b.where(b > 0)).fillna(default)


def bar_features(bars: pd.DataFrame) -> pd.DataFrame:
    """The model inputs and roc_3 of each bar; needs up to twenty earlier bars of the same day."""
    b = bars
    roll = lambda c, n: b[c].astype(float).rolling(n, min_periods=1)
    bid = b[levels("bqty", DEPTH)].sum(axis=1)
    ask = b[levels("aqty", DEPTH)].sum(axis=1)
    delta = b["buy_vol_1m"] - b["sell_vol_1m"]
    delta5 = roll("buy_vol_1m", 5).sum() - roll("sell_vol_1m", 5).sum()
    ratio1, ratio5 = delta / (b["volume_1m"] + 1e-8), delta5 / (roll("volume_1m", 5).sum() + 1e-8)
    back = lambda n: b["ltp"].shift(n)
    ret = lambda n: ((b["ltp"] - back(n)) / back(n).replace(0, np.nan)).fillna(0.0)
    ret1, ret5 = ret(1), ret(5)
    last_bid = bid.shift(1).fillna(0.0)
    against = lambda r, m: (-r * m).where((r < 0) & (m > 0), 0.0)
    close3 = b["close_price"].shift(3)
    made = {
        "large_trade_ratio": _over(b["large_trade_count_1m"], b["trade_count_1m"]), "delta_1m": delta,
        "volume_burst": _over(b["volume_1m"], roll("volume_1m", 20).mean(), 1.0),
        "aggressor_ratio": _over(b["buy_vol_1m"], b["volume_1m"], 0.5),
        "trade_count_burst": _over(b["trade_count_1m"], roll("trade_count_1m", 20).mean(), 1.0),
        "imbalance_top5": ((bid - ask) / (bid + ask).replace(0, np.nan)).fillna(0.0), "spread": b["ask1"] - b["bid1"],
        "depth_drop_bid": bid.diff().fillna(0.0), "depth_drop_ask": ask.diff().fillna(0.0),
        "vwap_distance": _over(b["ltp"] - b["vwap_1m"], b["vwap_1m"]),
        "volatility_5m": roll("ltp", 5).std().fillna(0.0), "price_acceleration": b["ltp"].diff().diff().fillna(0.0),
        "iceberg_score": _over(b["volume_1m"], bid + ask).mul(100.0).clip(upper=100.0),
        "bid_replenishment_rate": ((bid - last_bid) / last_bid.replace(0, np.nan)).clip(0.0, 1.0).where(
            (b["bid1"] >= b["bid1"].shift(1)) & (last_bid > 0), 0.0),
        "absorption_buyer_1m": against(ratio1, ret1), "absorption_buyer_5m": against(ratio5, ret5),
        "absorption_seller_1m": against(-ratio1, -ret1), "absorption_seller_5m": against(-ratio5, -ret5),
        "roc_3": ((b["close_price"] - close3) / close3 * 100.0).fillna(0.0),
    }
    return pd.DataFrame({c: made[c].astype(float) for c in [*MODEL_FEATURES, "roc_3"]})
