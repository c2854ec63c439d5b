"""Rate of change, crosses, running VWAP and other bar-sequence columns.

Windows here run over bars, which the clock bounds: (symbol, day) holds at most one row per
bar time, and a symbol across days holds that many per trading day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.schema import KEYS

ROC_THRESHOLD = 1.0


def roc(n: int = 3, price: str = "close_price", keys: tuple[str, ...] = KEYS,
        fill: float | None = 0.0, scale: float = 100.0) -> Column:
    """Change over n rows in percent; ``fill`` for the first n rows.

    keys=('symbol',) carries the last closes of earlier days into a new day.
    """
    back = F.lag(price, n).over(Window.partitionBy(*keys).orderBy("ts"))
    change = (F.col(price) - back) / F.nullif(back, F.lit(0.0)) * scale
    return change if fill is None else F.coalesce(change, F.lit(fill))


def running_vwap(keys: tuple[str, ...] = KEYS) -> dict[str, Column]:
    """Running VWAP (daily open while nothing traded) and daily open."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    value = F.sum(F.col("vwap_1m") * F.col("volume_1m")).over(w)
    volume = F.sum("volume_1m").over(w)
    daily_open = F.first("ltp").over(w)
    return {"daily_open": daily_open,
            "running_vwap": F.when(volume > 0, value / volume).otherwise(daily_open)}


def crosses(bars: DataFrame, roc_col: str = "roc_3", threshold: float = ROC_THRESHOLD,
            keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Upward and downward crosses, their running counts and the second-or-later flags."""
    w = Window.partitionBy(*keys).orderBy("ts")
    now, was = F.col(roc_col), F.lag(roc_col).over(w)
    flag = lambda c: F.coalesce(c, F.lit(False))
    out = bars.withColumns({
        "long_cross": flag((now >= threshold) & (was < threshold)),
        "short_cross": flag((now <= -threshold) & (was > -threshold)),
    })
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"{s}_cross_n": F.sum(F.col(f"{s}_cross").cast("bigint")).over(upto)
                           for s in ("long", "short")})
    return out.withColumns({f"{s}_double_cross": F.col(f"{s}_cross") & (F.col(f"{s}_cross_n") >= 2)
                            for s in ("long", "short")})


def first_event(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The earliest row of each group."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def next_bar_exits(bars: DataFrame, horizons: tuple[int, ...] = (30, 60),
                   keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Entry at the next bar's open; closes h bars on (entry bar is the first) or the last close."""
    w = Window.partitionBy(*keys).orderBy("ts")
    last = F.last("close_price").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    exits = {f"exit_{h}m": F.coalesce(F.lead("close_price", h).over(w), last) for h in horizons}
    return bars.withColumns({
        "entry_price": F.lead("open_price", 1).over(w), "entry_ts": F.lead("ts", 1).over(w),
        **exits, "exit_eod": last,
    })


def entry_cost_bps(entry_ts: str = "entry_ts", early_until: str = "10:00:00",
                   early: float = 30.0, later: float = 15.0) -> Column:
    """Higher cost before 10:00 exchange time.  Times before the exchange's midnight-to-UTC
    offset (local 00:00-05:30) belong to the previous UTC day and count as later."""
    clock = exchange_time(entry_ts)
    return F.when((clock < early_until) & (clock >= "05:30:00"), F.lit(early)).otherwise(F.lit(later))


def with_trailing_volatility(bars: DataFrame, n: int = 20, at_least: int = 5, price: str = "close_price",
                             keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """vol_20m: trailing deviation in bps; too few returns take the median of all bars."""
    w = Window.partitionBy(*keys).orderBy("ts")
    span = w.rowsBetween(-(n - 1), 0)
    back = F.lag(price).over(w)
    out = bars.withColumn("ret_1m", (F.col(price) - back) / F.nullif(back, F.lit(0.0)))
    out = out.withColumn("vol_raw", F.when(F.count("ret_1m").over(span) >= at_least,
                                           F.stddev_samp("ret_1m").over(span) * 10000.0))
    median = exact_quantiles(out, "vol_raw", [0.5]).select(F.col("q")[0].alias("median_vol"))
    return out.crossJoin(F.broadcast(median)).withColumn(
        "vol_20m", F.coalesce("vol_raw", "median_vol")).drop("vol_raw", "median_vol")


def systematic_sample(df: DataFrame, k: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Every k-th row of each group in time order, starting with the first."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") - 1) % k == 0).drop("_rn")
