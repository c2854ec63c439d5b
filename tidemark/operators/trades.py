"""Trade inference: executed trades read off the change between successive book snapshots.

Rules, per snapshot against the previous one of the same symbol and day:

* best ask moved up: every earlier ask level below the new best was bought (priority 1);
  an earlier level equal to the new best was bought for the quantity it lost (priority 2);
* best ask unchanged and its quantity fell: the difference was bought (priority 1);
* bids mirror this as sales;
* no trade at that time although the last price moved: one unit at the last price
  (priority 3), a buy at or above the earlier mid price.

Plan.  A classic ``lag`` partitioned by (symbol, day) puts a hot symbol-day into one task.
Here the first window is partitioned by (symbol, day, time chunk), so the bulk shuffle spreads
every symbol over its chunks.  What a chunk cannot know is the snapshot before its first row.
Only chunk edges (first and last rows) keep their book for the second, much smaller shuffle,
where a window over the edges alone supplies that snapshot; interior rows carry nothing but
the trades already found.  One scan, no self-join, no 4N+2-way union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import floor_to
from tidemark.operators.schema import KEYS, depth_of

_TYPE = "array<struct<price:double,qty:bigint,direction:string,priority:int,level_idx:int>>"
_NONE = f"CAST(array() AS {_TYPE})"


def _state(depth: int) -> str:
    """The part of a snapshot that inference needs, as one struct."""
    def side(px: str, qty: str) -> str:
        levels = ", ".join(f"named_struct('px', CAST({px}{i} AS double), 'qty', CAST({qty}{i} AS bigint))"
                           for i in range(1, depth + 1))
        return f"array({levels})"

    return (f"named_struct('ltp', CAST(ltp AS double), 'bids', {side('bid', 'bqty')}, "
            f"'asks', {side('ask', 'aqty')})")


def _trade(price: str, qty: str, direction: str, priority: int, level: str) -> str:
    return (f"named_struct('price', CAST({price} AS double), 'qty', CAST({qty} AS bigint), 'direction', {direction}, "
            f"'priority', {priority}, 'level_idx', CAST({level} AS int))")


def _side_trades(side: str, direction: str) -> str:
    """Trades of one book side from the columns ``now`` and ``prev``."""
    through = "<" if side == "asks" else ">"
    best, was = f"now.{side}[0]", f"prev.{side}[0]"
    swept = f"""filter(transform(prev.{side}, (x, i) -> CASE
        WHEN x.px {through} {best}.px AND x.px > 0 AND x.qty > 0 THEN {_trade('x.px', 'x.qty', direction, 1, 'i + 1')}
        WHEN x.px = {best}.px AND x.qty > {best}.qty
          THEN {_trade(f'{best}.px', f'x.qty - {best}.qty', direction, 2, 'i + 1')} END), t -> t IS NOT NULL)"""
    held = f"array({_trade(f'{was}.px', f'{was}.qty - {best}.qty', direction, 1, '1')})"
    return f"""CASE WHEN {was}.px > 0 AND {was}.px {through} {best}.px THEN {swept}
      WHEN {was}.px > 0 AND {was}.px = {best}.px AND {was}.qty > {best}.qty THEN {held} ELSE {_NONE} END"""


_BOOK_TRADES = f"concat({_side_trades('asks', chr(39) + 'BUY' + chr(39))}, {_side_trades('bids', chr(39) + 'SELL' + chr(39))})"
_PRICE_SIDE = ("CASE WHEN prev.asks[0].px > 0 AND prev.bids[0].px > 0 AND now.ltp < (prev.asks[0].px + prev.bids[0].px) / 2D "
               "THEN 'SELL' ELSE 'BUY' END")
_PRICE_MOVED = "prev.ltp IS NOT NULL AND now.ltp <> prev.ltp AND now.ltp > 0"
_PRICE_TRADE = f"array({_trade('now.ltp', '1', _PRICE_SIDE, 3, '1')})"


def infer_trades(book: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts", seq: str = "seq",
                 chunk: str = "1 hour") -> DataFrame:
    """keys, ts, seq, trade_price, trade_qty, direction, priority, level_idx."""
    key = ", ".join(keys)
    window = lambda part, order=True: f"PARTITION BY {key}, {part}" + (f" ORDER BY {ts}, {seq}" if order else "")
    found = f"CASE WHEN prev IS NOT NULL AND {{resolve}} THEN {_BOOK_TRADES} ELSE {{keep}} END AS found"
    priced = ("CASE WHEN {resolve} AND at_time = 0 AND " + _PRICE_MOVED + f" THEN {_PRICE_TRADE} ELSE found END AS found")

    staged = book.select(*keys, ts, seq, floor_to(ts, chunk).alias("chunk"), F.expr(_state(depth_of(book.columns))).alias("now"))
    inside = window("chunk")
    staged = staged.selectExpr(
        *keys, ts, seq, "chunk", "now", f"lag(now) OVER ({inside}) AS prev",
        f"{ts} = first({ts}) OVER ({inside}) AS head", f"lead({ts}) OVER ({inside}) IS NULL AS tail")
    staged = staged.selectExpr("*", found.format(resolve="NOT head", keep=_NONE))
    staged = staged.selectExpr("*", f"max(size(found)) OVER ({window(f'chunk, {ts}', False)}) AS at_time")
    reduced = staged.selectExpr(
        *keys, ts, seq, "head", "tail", "chunk", "now", priced.format(resolve="NOT head"),
    ).where("head OR tail OR size(found) > 0").selectExpr(
        *keys, ts, seq, "head", "found", "CASE WHEN head OR tail THEN now END AS now",
        "CASE WHEN NOT (head OR tail) THEN chunk END AS grp")
    joined = reduced.selectExpr("*", f"lag(now) OVER ({window('grp')}) AS prev")
    joined = joined.selectExpr(*keys, ts, seq, "head", "grp", "now", "prev", found.format(resolve="head", keep="found"))
    joined = joined.selectExpr(
        "*", f"max(CASE WHEN head THEN size(found) END) OVER ({window(f'grp, {ts}', False)}) AS at_time")
    return joined.selectExpr(*keys, ts, seq, f"explode({priced.format(resolve='head').removesuffix(' AS found')}) AS t").selectExpr(
        *keys, ts, seq, "t.price AS trade_price", "t.qty AS trade_qty", "t.direction", "t.priority", "t.level_idx")


def ordered_trades(trades: DataFrame, keys: tuple[str, ...] = KEYS, ts: str = "ts") -> DataFrame:
    """Write order: time, then rule priority, then level."""
    return trades.sortWithinPartitions(*keys, ts, "priority", "level_idx")


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    buy = F.col("direction") == "BUY"
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(buy).alias("buys"),
        F.count_if(~buy).alias("sells"),
        (F.count_if(buy) * 100.0 / F.count(F.lit(1))).alias("buy_pct"),
        F.sum("trade_qty").cast("bigint").alias("volume"),
        F.avg("trade_qty").alias("mean_qty"),
        F.max("trade_qty").alias("max_qty"),
        F.min("trade_price").alias("min_price"),
        F.max("trade_price").alias("max_price"),
    )
