"""Time bars from snapshots and trades.

Every bar is one hash aggregate on (keys, bar time): partial sums on the map side, so a hot
symbol arrives at the reducers already cut down to one row per bar and map task.
First and last prices use a numeric order key for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import floor_to, order_key, seconds_of
from tidemark.functions.scalars import add_all, ratio
from tidemark.operators.schema import FEATURE_DEPTH, GARBAGE_COLUMNS, KEYS, levels_in

TRADE_SUMS = ["buy_vol_1m", "sell_vol_1m", "volume_1m", "trade_count_1m", "large_trade_count_1m"]


def book_bars(book: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts", seq: str | None = "seq",
              bar: str = "1 minute") -> DataFrame:
    """First, mean and last price plus the mean of every numeric column, per bar."""
    skip = {*keys, ts, seq, "ltp", *GARBAGE_COLUMNS}
    numeric = [f.name for f in book.schema.fields
               if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    key = order_key(ts, seq)
    bars = book.groupBy(*keys, floor_to(ts, bar).alias("bar_ts")).agg(
        F.min_by("ltp", key).alias("open_price"),
        F.avg("ltp").alias("ltp"),
        F.max_by("ltp", key).alias("close_price"),
        *[F.avg(c).alias(c) for c in numeric],
    ).withColumnRenamed("bar_ts", "ts")
    return with_depth_totals(bars)


def with_depth_totals(bars: DataFrame, depth: int = FEATURE_DEPTH) -> DataFrame:
    """Total quantities from the top levels that exist, replacing any feed totals."""
    return bars.withColumns({
        "total_bid_qty": add_all(levels_in(bars.columns, "bqty", depth)),
        "total_ask_qty": add_all(levels_in(bars.columns, "aqty", depth)),
    })


def ohlc_bars(df: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts", seq: str | None = "seq",
              price: str = "ltp", bar: str = "1 minute") -> DataFrame:
    key = order_key(ts, seq)
    return df.groupBy(*keys, floor_to(ts, bar).alias("bar_ts")).agg(
        F.min_by(price, key).alias("open_price"), F.max(price).alias("high_price"),
        F.min(price).alias("low_price"), F.max_by(price, key).alias("close_price"),
        F.avg(price).alias("ltp"),
    ).withColumnRenamed("bar_ts", "ts")


def trade_bars(trades: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts", bar: str = "1 minute") -> DataFrame:
    """Buy, sell and total volume, counts, value and VWAP per bar.

    Uses the column ``is_large`` where the trades carry one; without it no trade is large.
    """
    qty = F.col("trade_qty")
    large = F.sum(F.col("is_large").cast("bigint")) if "is_large" in trades.columns else F.lit(0)
    side = lambda d: F.sum(F.when(F.col("direction") == d, qty).otherwise(F.lit(0))).cast("bigint")
    return (
        trades.groupBy(*keys, floor_to(ts, bar).alias("bar_ts")).agg(
            side("BUY").alias("buy_vol_1m"), side("SELL").alias("sell_vol_1m"),
            F.sum(qty).cast("bigint").alias("volume_1m"), F.count(qty).alias("trade_count_1m"),
            large.cast("bigint").alias("large_trade_count_1m"),
            F.sum(F.col("trade_price") * qty).alias("trade_value_1m"),
        )
        .withColumnRenamed("bar_ts", "ts")
        .withColumn("vwap_1m", ratio(F.col("trade_value_1m"), F.col("volume_1m")))
    )


def flag_large_by_median(trades: DataFrame, keys: tuple[str, ...] = KEYS, times: float = 10.0) -> DataFrame:
    """is_large against the median of the whole group (looks ahead; for the dense bars).

    The exact median is taken over (group, quantity) counts, so the wide shuffle carries one
    row per distinct quantity, not one per trade.
    """
    counts = trades.groupBy(*keys, "trade_qty").agg(F.count(F.lit(1)).alias("n"))
    medians = counts.groupBy(*keys).agg(
        F.percentile("trade_qty", F.lit(0.5), F.col("n")).alias("median_qty"))
    return trades.join(medians, list(keys)).withColumn(
        "is_large", (F.col("trade_qty") > F.col("median_qty") * times).cast("int"))


def dense_trade_bars(trades: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts",
                     bar: str = "1 minute", times: float = 10.0) -> DataFrame:
    """Trade bars on a gap-free grid between the first and last bar of each group; empty bars are 0."""
    flagged = flag_large_by_median(trades, keys, times)
    bars = trade_bars(flagged, keys, ts, bar)
    step = F.expr(f"INTERVAL {seconds_of(bar)} SECONDS")
    grid = bars.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        *keys, F.explode(F.sequence("lo", "hi", step)).alias("ts"))
    return grid.join(bars, [*keys, "ts"], "left").select(
        *keys, "ts",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in TRADE_SUMS],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("trade_value_1m", "vwap_1m")],
    )


def bars_with_trades(bars: DataFrame, trade_sums: DataFrame, keys: tuple[str, ...] = KEYS,
                     how: str = "left") -> DataFrame:
    """Trade aggregates joined onto book bars; bars without trades get zeros."""
    wanted = trade_sums.select(*keys, "ts", *TRADE_SUMS, "vwap_1m")
    kept = [c for c in bars.columns if c not in (*TRADE_SUMS, "vwap_1m")]
    return bars.select(*kept).join(wanted, [*keys, "ts"], how).withColumns({
        **{c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in TRADE_SUMS},
        "vwap_1m": F.coalesce(F.col("vwap_1m"), F.lit(0.0)),
    })


def enrich_with_ohlc(bars: DataFrame, ohlc: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Replace open/high/low/close by the true values; a bar without ticks keeps its mean price."""
    prices = ["open_price", "high_price", "low_price", "close_price"]
    kept = [c for c in bars.columns if c not in prices]
    return bars.select(*kept).join(ohlc.select(*keys, "ts", *prices), [*keys, "ts"], "left").withColumns(
        {c: F.coalesce(F.col(c), F.col("ltp")) for c in prices})


def minute_grid(bars: DataFrame, keys: tuple[str, ...] = KEYS, bar: str = "1 minute") -> DataFrame:
    """Complete the time line of each group and carry the last close forward."""
    step = F.expr(f"INTERVAL {seconds_of(bar)} SECONDS")
    grid = bars.groupBy(*keys).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(
        *keys, F.explode(F.sequence("lo", "hi", step)).alias("ts"))
    w = Window.partitionBy(*keys).orderBy("ts")
    return grid.join(bars, [*keys, "ts"], "left").withColumn(
        "close_price", F.last("close_price", ignorenulls=True).over(w))

