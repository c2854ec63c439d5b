"""All registered queries and their SQL checks."""

from __future__ import annotations

import functools
import importlib

from tidemark.catalog.inputs import BAR, book, naive_ts, rd
from tidemark.operators.bars import bars_with_trades, book_bars, trade_bars
from tidemark.operators.features import trade_flow
from tidemark.operators.trades import infer_trades
from tidemark.session import ship_package

MODULES = ("raw", "bars_features", "events", "research", "streams")


def _in_utc(fn):
    """Stored times are UTC; a caller's session may be set to another zone."""
    @functools.wraps(fn)
    def run(spark, sf):
        ship_package(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)
    return run


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tidemark.catalog.{name}"), attribute)
        repeated = out.keys() & part.keys()
        if repeated:
            raise ValueError(f"query registered twice: {sorted(repeated)}")
        out.update(part)
    return out


def queries() -> dict:
    return {name: _in_utc(fn) for name, fn in _merged("QUERIES").items()}


def sql() -> dict[str, str]:
    return _merged("SQL")


@_in_utc
def flagship(spark, sf: str):
    snapshots = book(spark, sf)
    trades = infer_trades(snapshots)
    bars = trade_flow(bars_with_trades(book_bars(snapshots, bar=BAR), trade_bars(trades, bar=BAR)))
    return naive_ts(bars.select("symbol", "trade_date", "ts", "close_price", "delta_1m",
                                rd("volume_burst", 6).alias("volume_burst"),
                                rd("aggressor_ratio", 6).alias("aggressor_ratio")))
