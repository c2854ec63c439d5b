"""Bar features.

Bars have at most one row per bar time, so a (symbol, day) partition is bounded by the clock
(1,440 one-minute bars), however hot the symbol is: windows over bars need no salting.
All features of one call share one window partitioning, hence one shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import floor_to
from tidemark.functions.scalars import add_all, clamp, ratio
from tidemark.operators.schema import FEATURE_DEPTH, FEATURE_RANGES, KEYS, levels_in
from tidemark.session import stage

EPS = 1e-8


def _series(keys):
    return Window.partitionBy(*keys).orderBy("ts")


def trade_flow(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Deltas, bursts, aggressor and large-trade ratios."""
    w = _series(keys)
    five, twenty = w.rowsBetween(-4, 0), w.rowsBetween(-19, 0)
    vol, cnt = F.col("volume_1m"), F.col("trade_count_1m")
    burst = lambda x: F.when(F.avg(x).over(twenty) > 0, x / F.avg(x).over(twenty)).otherwise(F.lit(1.0))
    return bars.withColumns({
        "delta_1m": F.col("buy_vol_1m") - F.col("sell_vol_1m"),
        "delta_5m": F.sum("buy_vol_1m").over(five) - F.sum("sell_vol_1m").over(five),
        "volume_burst": burst(vol),
        "aggressor_ratio": ratio(F.col("buy_vol_1m"), vol, 0.5),
        "trade_count_burst": burst(cnt),
        "large_trade_ratio": ratio(F.col("large_trade_count_1m"), cnt),
    })


def price_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """VWAP distance, short volatility, acceleration, 1- and 5-bar returns."""
    w = _series(keys)
    ltp, back = F.col("ltp"), lambda n: F.lag("ltp", n).over(w)
    ret = lambda n: F.coalesce((ltp - back(n)) / F.nullif(back(n), F.lit(0.0)), F.lit(0.0))
    return bars.withColumns({
        "vwap_distance": ratio(ltp - F.col("vwap_1m"), F.col("vwap_1m")),
        "volatility_5m": F.coalesce(F.stddev_samp("ltp").over(w.rowsBetween(-4, 0)), F.lit(0.0)),
        "price_acceleration": F.coalesce((ltp - back(1)) - (back(1) - back(2)), F.lit(0.0)),
        "return_1m": ret(1),
        "return_5m": ret(5),
    })


def absorption(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Delta ratios and absorption: flow and price moving against each other."""
    five = _series(keys).rowsBetween(-4, 0)
    out = bars.withColumns({
        "delta_1m_ratio": F.col("delta_1m") / (F.col("volume_1m") + EPS),
        "delta_5m_ratio": F.col("delta_5m") / (F.sum("volume_1m").over(five) + EPS),
    })
    opposed = {}
    for n in ("1m", "5m"):
        d, r = F.col(f"delta_{n}_ratio"), F.col(f"return_{n}")
        opposed[f"absorption_buyer_{n}"] = F.when((d < 0) & (r > 0), -d * r).otherwise(F.lit(0.0))
        opposed[f"absorption_seller_{n}"] = F.when((d > 0) & (r < 0), d * -r).otherwise(F.lit(0.0))
    return out.withColumns(opposed)


def depth_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Imbalance, spread and depth changes of book bars.  Run before any window-validity filter."""
    w = _series(keys)
    bid = add_all(levels_in(bars.columns, "bqty"))
    ask = add_all(levels_in(bars.columns, "aqty"))
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    return bars.withColumns({
        "imbalance_top5": F.when(bid + ask != 0, (bid - ask) / (bid + ask)).otherwise(F.lit(0.0)),
        "spread": F.col("ask1") - F.col("bid1"),
        "depth_drop_bid": step("total_bid_qty"),
        "depth_drop_ask": step("total_ask_qty"),
    })


def micro_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Iceberg score, cancel rate and bid replenishment.  Run after the window-validity filter.

    order_cancel_rate is 0 by construction wherever volume is not negative: it needs depth to
    be placed and removed by one signed change.  Kept because callers expect the column.
    """
    w = _series(keys)
    shown = add_all(levels_in(bars.columns, "bqty", FEATURE_DEPTH) + levels_in(bars.columns, "aqty", FEATURE_DEPTH))
    bid, prev_bid = F.col("total_bid_qty"), F.coalesce(F.lag("total_bid_qty").over(w), F.lit(0.0))
    change = (F.coalesce(bid - F.lag("total_bid_qty").over(w), F.lit(0.0))
              + F.coalesce(F.col("total_ask_qty") - F.lag("total_ask_qty").over(w), F.lit(0.0)))
    placed = F.greatest(change, F.lit(0.0))
    removed = F.greatest(-change, F.lit(0.0))
    cancelled = F.greatest(F.lit(0.0), removed - F.col("volume_1m"))
    return bars.withColumns({
        "iceberg_score": F.when(shown > 0, F.least(F.lit(100.0), F.col("volume_1m") / shown * 100.0)).otherwise(F.lit(0.0)),
        "order_cancel_rate": F.when(placed > 0, F.least(F.lit(1.0), cancelled / placed)).otherwise(F.lit(0.0)),
        "bid_replenishment_rate": F.when(
            (F.col("bid1") >= F.lag("bid1").over(w)) & (prev_bid > 0),
            clamp((bid - prev_bid) / prev_bid, 0.0, 1.0)).otherwise(F.lit(0.0)),
    })


def all_features(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every bar feature on bars that already carry depth features and trade sums."""
    return absorption(price_features(trade_flow(micro_features(bars, keys), keys), keys), keys)


# --------------------------------------------------------------------------- large trades

MEDIAN_SPAN = 10_000


def numbered(df: DataFrame, keys: tuple[str, ...], order: list[str], chunk: str, ts: str = "ts") -> DataFrame:
    """Row number ``rn`` and group size ``total``, without a window over the whole group.

    Rows are numbered inside (keys, chunk); the running count of earlier chunks is added from
    a table with one row per chunk.  The bulk is shuffled once, on (keys, chunk).
    """
    staged = stage(df.withColumn("chunk", floor_to(ts, chunk)))  # counted, then numbered
    sizes = staged.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
    )
    inner = Window.partitionBy(*keys, "chunk").orderBy(*order)
    return (
        staged.join(offsets, [*keys, "chunk"])
        .withColumn("rn", F.row_number().over(inner) + F.col("offset"))
        .drop("chunk", "offset")
    )


def large_trade_flag(trades: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts",
                     order: tuple[str, ...] = ("ts", "seq", "priority", "level_idx"),
                     span: int = MEDIAN_SPAN, times: float = 10.0, chunk: str = "1 hour") -> DataFrame:
    """is_large: quantity above ``times`` the running median of the last ``span`` trades.

    The median is refreshed every 5th trade up to the 50th and every 50th after that; once the
    span is full its length no longer changes and every trade refreshes it.  A trade never sees
    later trades.  Trades are cut into blocks of ``span`` rows and each block is handed its
    predecessor as context, so no task ever holds more than 2 x span trades of a group, and the
    result equals the one-pass form for any group size.
    """
    if span % 50:
        raise ValueError("span must be a multiple of 50")
    order = [c for c in order if c in trades.columns]
    rows = numbered(trades, keys, order, chunk, ts)
    own = F.floor((F.col("rn") - 1) / F.lit(span))
    follows = F.col("total") > (own + 1) * F.lit(span)
    shared = rows.withColumn("block", F.explode(F.when(follows, F.array(own, own + 1)).otherwise(F.array(own))))
    shared = shared.withColumn("context", F.col("block") != own).drop("total")
    out_fields = T.StructType([*trades.schema.fields, T.StructField("is_large", T.IntegerType())])

    def flag(block_rows: pa.Table) -> pa.Table:
        rows = block_rows.sort_by("rn")
        qty = rows["trade_qty"].to_numpy()
        limit = np.full(len(qty), np.inf)
        if rows["block"][0].as_py() == 0:
            points = [p for p in (*range(5, 51, 5), *range(100, span + 1, 50)) if p <= len(qty)]
            for p, until in zip(points, [*points[1:], len(qty) + 1]):
                limit[p - 1:until - 1] = times * np.median(qty[:p])
        else:
            limit = times * pd.Series(qty).rolling(span, min_periods=1).median().to_numpy()
        rows = rows.append_column("is_large", pa.array((qty > limit).astype("int32")))
        return rows.filter(pc.invert(rows["context"])).select(out_fields.names)

    return shared.groupBy(*keys, "block").applyInArrow(flag, out_fields)


# --------------------------------------------------------------------------- quality gate

def quality_gate(features: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """feature, nulls, actual range, allowed range, passed: one scan, one row per feature."""
    ranges = {f: r for f, r in (ranges or FEATURE_RANGES).items() if f in features.columns}
    aggs = [
        F.struct(
            F.lit(f).alias("feature"),
            F.count_if(F.col(f).isNull()).alias("nulls"),
            F.min(F.col(f).cast("double")).alias("actual_min"),
            F.max(F.col(f).cast("double")).alias("actual_max"),
            F.lit(float(lo)).alias("allowed_min"),
            F.lit(float(hi)).alias("allowed_max"),
        )
        for f, (lo, hi) in ranges.items()
    ]
    ok = ((F.col("nulls") == 0)
          & ~F.coalesce(F.col("actual_min") < F.col("allowed_min"), F.lit(False))
          & ~F.coalesce(F.col("actual_max") > F.col("allowed_max"), F.lit(False)))
    return (
        features.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
        .withColumn("passed", ok)
    )


def cross_section(bars: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """z-score of each column across all symbols at the same bar time.

    Statistics are a two-column aggregate joined back on the bar time, which keeps the
    map-side combine; a window would move every bar.
    """
    stats = bars.groupBy(ts).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}_std") for c in columns],
    )
    out = bars.join(stats, ts)
    return out.withColumns({
        f"{c}_z": F.when(F.col(f"{c}_std") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"))
                   .otherwise(F.lit(0.0)) for c in columns
    }).drop(*[f"{c}_{s}" for c in columns for s in ("mean", "std")])
