"""Composed plans: feature matrix, labelled bars, scored bars, batch stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.align import keep_windows, valid_windows
from tidemark.operators.bars import bars_with_trades, book_bars, trade_bars
from tidemark.operators.clean import clean_book, clean_ticks, extract_trades, with_trade_date
from tidemark.operators.features import all_features, depth_features, large_trade_flag
from tidemark.operators.labels import label_matrix
from tidemark.operators.schema import KEYS, is_unified
from tidemark.operators.trades import infer_trades
from tidemark.session import stage

NO_TRADE_DEFAULTS = {
    "delta_1m": 0.0, "delta_5m": 0.0, "volume_burst": 0.0, "aggressor_ratio": 0.5,
    "trade_count_burst": 0.0, "large_trade_ratio": 0.0, "iceberg_score": 0.0,
}
# Known only from trades; a day without any trade leaves them NULL.
TRADE_ONLY = [
    "vwap_1m", "vwap_distance", "volatility_5m", "price_acceleration", "return_1m", "return_5m",
    "delta_1m_ratio", "delta_5m_ratio", "absorption_buyer_1m", "absorption_buyer_5m",
    "absorption_seller_1m", "absorption_seller_5m",
]


def feature_matrix(book: DataFrame, ticks: DataFrame | None, trades: DataFrame | None = None,
                   tolerance_s: float = 1.0, bar: str = "1 minute", keys: tuple[str, ...] = KEYS,
                   seq: str = "seq", scores: dict[str, float] | None = None,
                   trade_order: tuple[str, ...] = ("ts", "seq", "priority", "level_idx")) -> DataFrame:
    """Bars with every feature, for windows both feeds cover well.

    A tick feed that carries five book levels itself is used as the book and needs no alignment.
    Without ticks there is nothing to validate against and the result is empty.  Depth changes
    are taken before the window filter, replenishment and flow features after it.
    """
    if ticks is None:
        nothing = book.limit(0)
        return feature_matrix(nothing, nothing.select(*keys, "ts", seq), trades, tolerance_s, bar, keys, seq, scores, trade_order)
    unified = is_unified(ticks.columns)
    bars = depth_features(book_bars(ticks if unified else book, keys, "ts", seq, bar), keys)
    if trades is None:
        # the large-trade flag reads the trades twice; inference must not run twice
        trades = stage(infer_trades(book, keys, "ts", seq))
    sums = trade_bars(large_trade_flag(trades, keys, order=trade_order), keys, "ts", bar)
    # The full join keeps bars with trades only just long enough to know which days traded.
    whole = Window.partitionBy(*keys)
    merged = bars_with_trades(bars.withColumn("_book", F.lit(True)), sums, keys, how="full").withColumn(
        "_traded", F.max("trade_count_1m").over(whole) > 0).where("_book").drop("_book")
    if not unified:
        valid = valid_windows(ticks, book, tolerance_s, bar, keys, "ts", seq, **(scores or {}))
        merged = keep_windows(merged, valid, keys)
    out = all_features(merged, keys)
    traded = F.col("_traded")
    fixed = {c: F.when(traded, F.col(c)).otherwise(F.lit(v)) for c, v in NO_TRADE_DEFAULTS.items()}
    fixed |= {c: F.when(traded, F.col(c)) for c in TRADE_ONLY}
    return out.withColumns(fixed).drop("_traded")


def labelled_matrix(features: DataFrame, keys: tuple[str, ...] = KEYS, **labels) -> DataFrame:
    return label_matrix(features, keys=keys, **labels)


def raw_to_labels(raw_book: DataFrame, raw_ticks: DataFrame, bar: str = "1 minute", session: bool = True,
                  use_executed: bool = False) -> DataFrame:
    """Raw feeds to labelled bars in one plan: clean, infer (or take executed trades), bars, features, labels."""
    keep = ("seq", "trade_date")
    book = clean_book(raw_book, session, keep)
    ticks = clean_ticks(raw_ticks, session, keep, drop_empty=False)
    if "trade_date" not in book.columns:
        book, ticks = with_trade_date(book), with_trade_date(ticks)
    trades = extract_trades(ticks) if use_executed else None
    return labelled_matrix(feature_matrix(book, ticks, trades, bar=bar))
