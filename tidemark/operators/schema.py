"""Column lists and constants of the data model."""

from __future__ import annotations

import re

KEYS = ("symbol", "trade_date")
MAX_DEPTH = 20
FEATURE_DEPTH = 5

# Columns left over from a broken export.
GARBAGE_COLUMNS = [
    "symbolbid17", "aqk9", "asbqty15", "bid1d15",
    "19", "im", "askqty", "aqtybid1",
]

# File stems that leaked into the symbol column.
SENTINEL_SYMBOLS = ["GRAPHITEticks", "MFticks", "JSWCEMENTdom_snapshots", "dom_snapshots"]


def levels(name: str, depth: int) -> list[str]:
    return [f"{name}{i}" for i in range(1, depth + 1)]


BOOK_COLUMNS = (
    ["ts", "symbol", "ltp", "total_bid_qty", "total_ask_qty", "imbalance"]
    + levels("bid", MAX_DEPTH) + levels("ask", MAX_DEPTH)
    + levels("bqty", MAX_DEPTH) + levels("aqty", MAX_DEPTH)
)

TICK_COLUMNS = [
    "ts", "symbol", "security_id", "ltp", "volume", "oi",
    "aggressor", "trade_qty", "bid1", "bqty1", "ask1", "aqty1", "cum_delta",
]

# Accepted range of each feature.
FEATURE_RANGES = {
    "delta_1m": (-1_000_000, 1_000_000),
    "delta_5m": (-5_000_000, 5_000_000),
    "volume_burst": (0.01, 100),
    "aggressor_ratio": (0, 1),
    "trade_count_burst": (0.01, 100),
    "large_trade_ratio": (0, 1),
    "imbalance_top5": (-1, 1),
    "spread": (0.01, 1000),
    "depth_drop_bid": (-1_000_000, 1_000_000),
    "depth_drop_ask": (-1_000_000, 1_000_000),
    "vwap_distance": (-0.5, 0.5),
    "volatility_5m": (0, 50),
    "price_acceleration": (-10, 10),
    "iceberg_score": (0, 100),
    "order_cancel_rate": (0, 1),
    "bid_replenishment_rate": (0, 1),
    "absorption_buyer_1m": (0, 1.0),
    "absorption_buyer_5m": (0, 1.0),
    "absorption_seller_1m": (0, 1.0),
    "absorption_seller_5m": (0, 1.0),
}

# Model inputs, in order.
MODEL_FEATURES = [
    "large_trade_ratio", "delta_1m", "volume_burst", "aggressor_ratio",
    "trade_count_burst", "imbalance_top5", "spread", "depth_drop_bid",
    "depth_drop_ask", "vwap_distance", "volatility_5m", "price_acceleration",
    "iceberg_score", "bid_replenishment_rate",
    "absorption_buyer_1m", "absorption_buyer_5m",
    "absorption_seller_1m", "absorption_seller_5m",
]

LABEL_HORIZONS = (30, 60, 120)
LABEL_THRESHOLDS = (0.01, 0.03, 0.05, 0.07)


def depth_of(columns: list[str], name: str = "bid") -> int:
    """Deepest level present, read from the column names."""
    found = [int(m.group(1)) for c in columns if (m := re.fullmatch(rf"{name}(\d+)", c))]
    return max(found, default=0)


def levels_in(columns: list[str], name: str, limit: int = FEATURE_DEPTH) -> list[str]:
    found = [c for c in columns if re.fullmatch(rf"{name}\d+", c)]
    return sorted(found, key=lambda c: int(c[len(name):]))[:limit]


def is_unified(columns: list[str]) -> bool:
    """A tick feed that already carries at least five book levels."""
    return all(len(levels_in(columns, side)) >= FEATURE_DEPTH for side in ("bqty", "aqty"))
