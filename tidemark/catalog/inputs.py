"""Order-flow views over the driver tables.

The view text is plain SQL that both engines accept, so the Spark query and its check start
from identical rows.  Every row of the table takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bars import bars_with_trades, ohlc_bars, trade_bars
from tidemark.operators.clean import extract_trades
from tidemark.operators.features import trade_flow
from tidemark.operators.momentum import roc

BAR = "15 minutes"
_ID = "concat('S', CAST(user_id % 16 AS STRING)) AS symbol, CAST(ts AS DATE) AS trade_date, event_id AS seq"


def _levels(depth: int, flat: bool) -> str:
    parts = []
    for i in range(1, depth + 1):
        px = "10000" if flat else "base"
        bq = "100 + event_id" if flat else f"100 + (event_id * {31 * i}) % 400"
        aq = "100 + event_id" if flat else f"100 + (event_id * {37 * i}) % 400"
        parts += [
            f"CAST({px} - {i} AS DOUBLE) / CAST(100 AS DOUBLE) AS bid{i}", f"CAST({bq} AS BIGINT) AS bqty{i}",
            f"CAST({px} + {i} AS DOUBLE) / CAST(100 AS DOUBLE) AS ask{i}", f"CAST({aq} AS BIGINT) AS aqty{i}",
        ]
    return ", ".join(parts)


def _book_text(flat: bool) -> str:
    return (
        f"SELECT ts, {_ID}, event_type, CAST(base AS DOUBLE) / CAST(100 AS DOUBLE) AS ltp, {_levels(5, flat)} "
        "FROM (SELECT *, CAST(10000 + (event_id * 7919) % 5 AS BIGINT) AS base FROM {events}) b"
    )


BOOK_TEXT = _book_text(False)
FLAT_BOOK_TEXT = _book_text(True)
TICK_TEXT = (
    f"SELECT ts, {_ID}, event_type, CAST(100 AS DOUBLE) + value / CAST(100 AS DOUBLE) AS ltp, "
    "event_id % 97 + 1 AS trade_qty, event_id AS volume, "
    "CASE WHEN event_type IN ('purchase', 'signup') THEN 'BUY' ELSE 'SELL' END AS aggressor "
    "FROM {events}"
)
# Two feeds for alignment: executions (purchase, signup) against all other activity.
TICK_FEED = "event_type IN ('purchase', 'signup')"
BOOK_FEED = "event_type NOT IN ('purchase', 'signup')"
LINEITEM_TEXT = (
    "SELECT concat('S', CAST(l_suppkey AS STRING)) AS symbol, CAST(l_shipdate AS DATE) AS trade_date, "
    "l_shipdate AS ts, l_orderkey AS seq, l_extendedprice / l_quantity AS trade_price, "
    "CAST(l_quantity AS BIGINT) AS trade_qty, "
    "CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS direction FROM {lineitem}"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _view(spark: SparkSession, sf: str, text: str, name: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf, name)})


def book(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, BOOK_TEXT, "events")


def flat_book(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, FLAT_BOOK_TEXT, "events")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, TICK_TEXT, "events")


def lineitem_trades(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, LINEITEM_TEXT, "lineitem")


def scored_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the tick view with trade sums, momentum and deterministic probabilities."""
    from pyspark.sql import Window

    t = ticks(spark, sf)
    sums = trade_bars(extract_trades(t), bar=BAR)
    bars = bars_with_trades(ohlc_bars(t, bar=BAR), sums)
    bars = bars.withColumns({"ltp": rd("ltp", 6), "vwap_1m": rd("vwap_1m", 6)})
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    return (
        trade_flow(bars).withColumn("roc_3", roc(3)).withColumn("roc_9", roc(9, keys=("symbol",), fill=None))
        .withColumn("bar_no", n)
        .withColumns({
            "prob_long": ((F.col("bar_no") * 37) % 100) / F.lit(100.0),
            "prob_short": ((F.col("bar_no") * 53) % 100) / F.lit(100.0),
            "prob_no_trade": ((F.col("bar_no") * 71) % 100) / F.lit(100.0),
        })
    )


# --------------------------------------------------------------------------- the same in SQL

def sql_book(flat: bool = False) -> str:
    return (FLAT_BOOK_TEXT if flat else BOOK_TEXT).format(events="events")


SQL_TICKS = TICK_TEXT.format(events="events")
SQL_LINEITEM = LINEITEM_TEXT.format(lineitem="lineitem")
SQL_BAR = "time_bucket(INTERVAL '15 minutes', ts)"

SQL_BARS = f"""
ticks AS ({SQL_TICKS}),
ohlc AS (
  SELECT symbol, trade_date, {SQL_BAR} AS ts,
    arg_min(ltp, seq) AS open_price, max(ltp) AS high_price, min(ltp) AS low_price,
    arg_max(ltp, seq) AS close_price, rd(avg(ltp), 6) AS ltp,
    CAST(sum(CASE WHEN aggressor = 'BUY' THEN trade_qty ELSE 0 END) AS BIGINT) AS buy_vol_1m,
    CAST(sum(CASE WHEN aggressor = 'SELL' THEN trade_qty ELSE 0 END) AS BIGINT) AS sell_vol_1m,
    CAST(sum(trade_qty) AS BIGINT) AS volume_1m, count(*) AS trade_count_1m,
    rd(sum(ltp * trade_qty) / sum(trade_qty), 6) AS vwap_1m
  FROM ticks GROUP BY ALL),
bars AS (
  SELECT *, ((n * 37) % 100) / CAST(100 AS DOUBLE) AS prob_long, ((n * 53) % 100) / CAST(100 AS DOUBLE) AS prob_short,
    ((n * 71) % 100) / CAST(100 AS DOUBLE) AS prob_no_trade
  FROM (
    SELECT *, buy_vol_1m - sell_vol_1m AS delta_1m,
      CASE WHEN avg(volume_1m) OVER w20 > 0 THEN volume_1m / avg(volume_1m) OVER w20 ELSE 1.0 END AS volume_burst,
      coalesce((close_price - lag(close_price, 3) OVER d) / lag(close_price, 3) OVER d * 100.0, 0.0) AS roc_3,
      (close_price - lag(close_price, 9) OVER s) / lag(close_price, 9) OVER s * 100.0 AS roc_9,
      row_number() OVER s AS n
    FROM ohlc
    WINDOW d AS (PARTITION BY symbol, trade_date ORDER BY ts), s AS (PARTITION BY symbol ORDER BY ts),
      w20 AS (PARTITION BY symbol, trade_date ORDER BY ts ROWS 19 PRECEDING)))
"""


def sql_clock(ts: str = "ts") -> str:
    return f"strftime({ts} + INTERVAL '330 minutes', '%H:%M:%S')"


def _nudge(places: int) -> float:
    return 1.37 * 10.0 ** -(places + 2)


def rd(c: Column | str, places: int) -> Column:
    """Round for display.  The nudge moves exact halves off the edge, where two engines that sum in
    different orders could fall to different sides; adding 0.0 removes the sign of zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(_nudge(places)), places) + F.lit(0.0)


def expand(sql: str) -> str:
    """rd(expression, places) in SQL text -> the same rounding as ``rd``."""
    while (at := re.search(r"\brd\(", sql)) is not None:
        depth, i, comma = 1, at.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        places = int(sql[comma + 1:i - 1])
        body = sql[at.end():comma]
        sql = f"{sql[:at.start()]}(round(({body}) + {_nudge(places):.3e}, {places}) + 0.0){sql[i:]}"
    return sql


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rd(c, places) for c in columns})


class Registry:
    """Queries and SQL checks of one module."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = expand(sql)
            return fn
        return add


def naive_ts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns or ("ts",)})


