"""Non-overlapping fixed-hold trades and the gate trace.

These rules are truly sequential: whether a bar may open a trade depends on when the previous
trade ends.  Spark groups and shuffles the bars; inside a group a small loop jumps from entry to
entry.  A group is one symbol-day of bars (or one symbol's bars across days), which the clock
bounds.  All parameter combinations are evaluated on the same group, so a sweep moves the bars
once, not once per combination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time
from tidemark.operators.schema import KEYS

HORIZONS = (30, 60, 120, 180)
EXPIRIES = (60, 120, 180, 240, 300, 360)
ROC_FRACTION = 0.01
ROC_ROWS = 9

TRADE_FIELDS = (
    "strategy string, horizon bigint, expiry bigint, alert_ts timestamp, entry_ts timestamp, exit_ts timestamp, "
    "direction string, entry_price double, exit_price double, pnl double, roc_at_entry double"
)


def _free_entries(candidates: np.ndarray, hold: int, n: int) -> Iterator[int]:
    """Candidates that start after the previous hold has ended."""
    at = 0
    while at < len(candidates):
        t = int(candidates[at])
        yield t
        at = int(np.searchsorted(candidates, min(t + hold, n - 1), side="right"))


def _confirmed_entries(side: np.ndarray, move: np.ndarray, hold: int, expiry: int | None, limit: float,
                       start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(bar, direction, alert bar): alerts count only while flat and lapse after ``expiry`` bars."""
    armed, since, t = 0, -1, start
    while t < n:
        if armed and expiry is not None and t - since > expiry:
            armed = 0
        if side[t]:
            armed, since = int(side[t]), t
        if armed and move[t] * armed >= limit:
            yield t, armed, since
            armed = 0
            t = min(t + hold, n - 1)
        t += 1


def hold_trades(bars: DataFrame, pred: str = "pred", strategies: tuple[str, ...] = ("model", "roc", "model_roc"),
                horizons: tuple[int, ...] = HORIZONS, expiries: tuple[int | None, ...] = EXPIRIES,
                keys: tuple[str, ...] = KEYS, roc_rows: int = ROC_ROWS, limit: float = ROC_FRACTION,
                start: int | None = None) -> DataFrame:
    """Trades of each strategy and parameter combination.

    model: every class prediction while flat.  roc: every move of at least ``limit`` over
    ``roc_rows`` rows.  model_roc: a prediction arms an alert that such a move must confirm
    within the expiry (None = never lapses).
    """
    first = roc_rows if start is None else start
    schema = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in keys) + ", " + TRADE_FIELDS

    def trade_group(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("ts")
        price, side, n = rows["ltp"].to_numpy(), rows["side"].to_numpy(), group.num_rows
        change = np.full(n, np.nan)
        if n > roc_rows:
            change[roc_rows:] = (price[roc_rows:] - price[:-roc_rows]) / price[:-roc_rows]
        move = np.nan_to_num(change, nan=0.0)
        moved = np.flatnonzero(np.abs(move) >= limit)
        found = []  # strategy, hold, expiry, alert bar, entry bar, direction
        for hold in horizons:
            if "model" in strategies:
                found += [("model", hold, None, t, t, side[t]) for t in _free_entries(np.flatnonzero(side), hold, n)]
            if "roc" in strategies:
                found += [("roc", hold, None, None, t, np.sign(move[t])) for t in _free_entries(moved, hold, n)]
            if "model_roc" in strategies:
                for expiry in expiries:
                    found += [("model_roc", hold, expiry, a, t, d)
                              for t, d, a in _confirmed_entries(side, move, hold, expiry, limit, first, n)]
        strategy, hold, expiry, alert, entry, direction = zip(*found) if found else [()] * 6
        entry = np.array(entry, dtype="int64")
        out = np.minimum(entry + np.array(hold, dtype="int64"), n - 1)
        sign = np.array(direction, dtype="float64")
        time = rows["ts"].combine_chunks()
        return pa.table({
            **{name: pa.array([k.as_py()] * len(entry), k.type) for name, k in zip(keys, key)},
            "strategy": pa.array(strategy, "string"), "horizon": pa.array(hold, "int64"),
            "expiry": pa.array(expiry, "int64"), "alert_ts": time.take(pa.array(alert, "int64")),
            "entry_ts": time.take(pa.array(entry)), "exit_ts": time.take(pa.array(out)),
            "direction": pa.array(["LONG" if d > 0 else "SHORT" for d in sign], "string"),
            "entry_price": price[entry], "exit_price": price[out],
            "pnl": (price[out] - price[entry]) / price[entry] * sign,
            "roc_at_entry": pa.array(change[entry] * 100.0, from_pandas=True),
        })

    side = F.when(F.col(pred) == "LONG", 1).when(F.col(pred) == "SHORT", -1).otherwise(0)
    narrow = bars.select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("ltp").cast("double").alias("ltp"),
                         side.alias("side"))
    return narrow.groupBy(*keys).applyInArrow(trade_group, schema)


def hold_without_expiry(bars: DataFrame, pred: str = "pred", horizon: int = 180) -> DataFrame:
    """Alert and confirmation per symbol across days: alerts never lapse, holds cross days."""
    return hold_trades(bars, pred, ("model_roc",), (horizon,), (None,), keys=("symbol",), start=1)


# --------------------------------------------------------------------------- gate trace

TRACE_FIELDS = "ts timestamp, clock string, event string, side string, prob double, ltp double, roc double"


def gate_trace(bars: DataFrame, theta: float = 0.25, bypasses: bool = False, roc_col: str = "roc_9",
               expiry: int = 60, roc_limit: float = 1.0, high_confidence: float = 0.35,
               keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Why each bar did or did not trigger: alert raised, expired, blocked (and by which gate), triggered."""
    schema = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in keys) + ", " + TRACE_FIELDS

    def trace_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        events, armed, since = [], 0, -1
        first = pdf["ltp"].iloc[0]
        reached = max(pdf["prob_long"].max(), pdf["prob_short"].max())

        def note(row, event, side):
            prob = row.prob_long if side > 0 else row.prob_short if side < 0 else reached
            events.append((*key, row.ts, row.clock, event, {1: "LONG", -1: "SHORT"}.get(side), prob, row.ltp, row.roc))

        if not reached >= theta:
            note(next(pdf.itertuples(index=False)), "NEVER_REACHED_THETA", 0)
            return pd.DataFrame(events, columns=columns)
        for t, row in enumerate(pdf.itertuples(index=False)):
            if armed and t - since > expiry:
                note(row, "EXPIRED", armed)
                armed = 0
            wanted = (1 if row.prob_long >= theta and row.prob_long > row.prob_short
                      else -1 if row.prob_short >= theta and row.prob_short > row.prob_long else 0)
            if wanted and wanted != armed:
                armed, since = wanted, t
                note(row, "ALERT", armed)
            if not armed:
                continue
            ahead = (row.ltp - first) * armed > 0
            hit = None
            if bypasses:
                early = "09:15:00" <= row.clock <= "09:30:00"
                sure = (row.prob_long if armed > 0 else row.prob_short) >= high_confidence
                if early or sure:
                    if ahead:
                        hit = "TRIGGER_MORNING" if early else "TRIGGER_HIGH_CONFIDENCE"
                    else:
                        note(row, "BYPASS_BLOCKED_OPEN", armed)
            if hit is None:
                if np.isnan(row.roc):
                    note(row, "BLOCKED_ROC_MISSING", armed)
                elif row.roc * armed < roc_limit:
                    note(row, "BLOCKED_ROC_LOW", armed)
                elif not ahead:
                    note(row, "BLOCKED_OPEN", armed)
                else:
                    hit = "TRIGGER_ROC"
            if hit:
                note(row, hit, armed)
                break  # held to the end of the day
        return pd.DataFrame(events, columns=columns)

    columns = [*keys, "ts", "clock", "event", "side", "prob", "ltp", "roc"]
    narrow = bars.select(*keys, F.col("ts").cast("timestamp").alias("ts"), exchange_time("ts").alias("clock"),
                         "ltp", F.col(roc_col).cast("double").alias("roc"), "prob_long", "prob_short")
    return narrow.groupBy(*keys).applyInPandas(trace_group, schema)
