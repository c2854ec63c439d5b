"""Alert-then-trigger trades: a class prediction arms an alert, momentum confirms it.

A prediction starts an alert or renews it; the opposite prediction replaces it; it expires
after ``expiry`` bars.  The first confirming bar consumes the alert.  Although this reads like
a state machine, the alert a bar belongs to is simply the latest prediction at or before it,
and a trigger is the first confirming bar since that prediction.  Everything below is running
windows over one (symbol, day) order: one shuffle, two sorts (forward and backward), no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time
from tidemark.operators.momentum import ROC_THRESHOLD, running_vwap
from tidemark.operators.schema import KEYS

EXPIRY = 360


def classify(theta: float | Column, long: str = "prob_long", short: str = "prob_short") -> Column:
    """LONG / SHORT when that probability reaches theta and beats the other one."""
    l, s = F.col(long), F.col(short)
    return (F.when((l >= theta) & (l > s), "LONG").when((s >= theta) & (s > l), "SHORT").otherwise("NO_TRADE"))


def _windows(keys):
    w = Window.partitionBy(*keys).orderBy("ts")
    return {
        "order": w,
        "upto": w.rowsBetween(Window.unboundedPreceding, 0),
        "before": w.rowsBetween(Window.unboundedPreceding, -1),
        # running over the reversed order: linear, where an unbounded-following frame is quadratic
        "onward": Window.partitionBy(*keys).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0),
        "hour": w.rowsBetween(0, 60),
    }


def mark_triggers(bars: DataFrame, pred: str = "pred", roc_col: str = "roc_9", trend: str = "none",
                  expiry: int = EXPIRY, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds rn, alert_rn, direction and the flag ``trigger`` to every bar.

    trend: 'none', 'open' (price beyond the day's first price) or 'vwap' (beyond the running VWAP).
    """
    w = _windows(keys)
    out = bars.withColumn("rn", F.row_number().over(w["order"]).cast("bigint"))
    if trend == "vwap":
        out = out.withColumns(running_vwap(keys))
    else:
        out = out.withColumn("daily_open", F.first("ltp").over(w["upto"]))
    alert = F.col(pred).isin("LONG", "SHORT")
    out = out.withColumns({
        "alert_rn": F.last(F.when(alert, F.col("rn")), ignorenulls=True).over(w["upto"]),
        "direction": F.last(F.when(alert, F.col(pred)), ignorenulls=True).over(w["upto"]),
    })
    level = {"none": None, "open": F.col("daily_open"), "vwap": F.col("running_vwap") if trend == "vwap" else None}[trend]
    up, down = F.col(roc_col) >= ROC_THRESHOLD, F.col(roc_col) <= -ROC_THRESHOLD
    if level is not None:
        up, down = up & (F.col("ltp") > level), down & (F.col("ltp") < level)
    confirmed = (
        (F.col("rn") - F.col("alert_rn") <= expiry)
        & F.when(F.col("direction") == "LONG", up).otherwise(down)
    )
    out = out.withColumn("confirmed", F.coalesce(confirmed, F.lit(False)))
    earlier = F.max(F.when(F.col("confirmed"), F.col("rn"))).over(w["before"])
    return out.withColumn(
        "trigger", F.col("confirmed") & (F.coalesce(earlier, F.lit(0)) < F.col("alert_rn"))).drop("confirmed")


def _with_excursions(marked: DataFrame, keys) -> DataFrame:
    w = _windows(keys)
    return marked.withColumns({
        "eod_price": F.first("ltp").over(w["onward"]),
        "hi_eod": F.max("ltp").over(w["onward"]), "lo_eod": F.min("ltp").over(w["onward"]),
        "hi_60": F.max("ltp").over(w["hour"]), "lo_60": F.min("ltp").over(w["hour"]),
    })


def _sided_returns() -> dict[str, Column]:
    entry = F.col("ltp")
    gain = lambda c: (F.col(c) - entry) / entry
    side = lambda a, b: F.when(F.col("direction") == "LONG", gain(a)).otherwise(-gain(b))
    return {
        "pnl": side("eod_price", "eod_price"),
        "mfe": side("hi_eod", "lo_eod"), "mae": side("lo_eod", "hi_eod"),
        "mfe_60m": side("hi_60", "lo_60"), "mae_60m": side("lo_60", "hi_60"),
    }


def alert_trades(bars: DataFrame, pred: str = "pred", roc_col: str = "roc_9", trend: str = "none",
                 expiry: int = EXPIRY, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per triggered trade, held to the last bar of the day."""
    marked = _with_excursions(mark_triggers(bars, pred, roc_col, trend, expiry, keys), keys)
    return marked.where("trigger").select(
        *keys, "ts", exchange_time("ts").alias("entry_time_ist"), "direction",
        F.col("ltp").alias("entry_price"), *[c.alias(n) for n, c in _sided_returns().items()])


def alert_trade_details(bars: DataFrame, pred: str = "pred", roc_col: str = "roc_3", expiry: int = EXPIRY,
                        keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Unfiltered trades with alert distance, distance from the day's extreme, and the time the
    open filter would first have allowed a trigger since the alert sequence began."""
    w = _windows(keys)
    marked = _with_excursions(mark_triggers(bars, pred, roc_col, "none", expiry, keys), keys)
    rn, price = F.col("rn"), F.col("ltp")
    alert = F.col(pred).isin("LONG", "SHORT")
    latest = lambda d: F.max(F.when(F.col(pred) == d, rn)).over(w["upto"])
    allowed = {
        "LONG": (rn - latest("LONG") <= expiry) & (F.col(roc_col) >= ROC_THRESHOLD) & (price > F.col("daily_open")),
        "SHORT": (rn - latest("SHORT") <= expiry) & (F.col(roc_col) <= -ROC_THRESHOLD) & (price < F.col("daily_open")),
    }
    out = marked.withColumns({f"ok_{d}": F.coalesce(c, F.lit(False)) for d, c in allowed.items()})
    # next allowed bar at or after each bar, per direction
    out = out.withColumns({
        f"next_{d}": F.last(F.when(F.col(f"ok_{d}"), exchange_time("ts")), ignorenulls=True).over(w["onward"])
        for d in allowed
    })
    prev_alert = F.max(F.when(alert, rn)).over(w["before"])
    prev_dir = F.last(F.when(alert, F.col(pred)), ignorenulls=True).over(w["before"])
    prev_trigger = F.max(F.when(F.col("trigger"), rn)).over(w["before"])
    # an alert opens a new sequence unless it renews a live one of the same direction
    fresh = alert & (
        prev_alert.isNull() | (prev_dir != F.col(pred)) | (rn - prev_alert > expiry + 1)
        | F.coalesce(prev_trigger >= prev_alert, F.lit(False)))
    out = out.withColumn("fresh", fresh)
    out = out.withColumn("sequence", F.last(F.when(F.col("fresh"), F.struct(
        F.when(F.col(pred) == "LONG", F.col("next_LONG")).otherwise(F.col("next_SHORT")).alias("open_time")
    )), ignorenulls=True).over(w["upto"]))
    out = out.withColumns({"low_so_far": F.min("ltp").over(w["upto"]), "high_so_far": F.max("ltp").over(w["upto"])})
    is_long = F.col("direction") == "LONG"
    low, high = F.col("low_so_far"), F.col("high_so_far")
    from_low = F.when(low > 0, (price - low) / low * 100.0).otherwise(F.lit(0.0))
    from_high = F.when(high > 0, (high - price) / high * 100.0).otherwise(F.lit(0.0))
    carried = [c for c in ("prob_long", "prob_short") if c in bars.columns]
    return out.where("trigger").select(
        *keys, "ts", exchange_time("ts").alias("entry_time_ist"), "direction",
        price.alias("entry_price"), F.col("eod_price").alias("exit_price"),
        *[c.alias(n) for n, c in _sided_returns().items()],
        *carried, F.col(roc_col).alias("roc"), "daily_open",
        (rn - F.col("alert_rn")).alias("alert_distance"),
        F.when(is_long, from_low).otherwise(from_high).alias("dist_low_high"),
        F.when(is_long, price > F.col("daily_open")).otherwise(price < F.col("daily_open")).alias("daily_open_passed"),
        F.col("sequence.open_time").alias("open_trigger_time"),
    )


def threshold_sweep(bars: DataFrame, thetas: list[float], roc_col: str = "roc_3", expiry: int = EXPIRY,
                    keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trades of every probability threshold; theta joins the group key.

    Symbol-days that never reach a theta are dropped for it before the windows.
    """
    day = Window.partitionBy(*keys)
    table = bars.sparkSession.createDataFrame([(float(t),) for t in thetas], "theta double")
    spread = (
        bars.withColumn("_best", F.greatest(F.max("prob_long").over(day), F.max("prob_short").over(day)))
        .crossJoin(F.broadcast(table)).where("_best >= theta").drop("_best")
        .withColumn("pred", classify(F.col("theta")))
    )
    return alert_trade_details(spread, "pred", roc_col, expiry, (*keys, "theta"))
