"""Cleaning: column projection, types, book and session filters, symbol filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import as_utc, in_session, parse_day
from tidemark.functions.scalars import is_equity, no_nan
from tidemark.operators.schema import (
    BOOK_COLUMNS, GARBAGE_COLUMNS, SENTINEL_SYMBOLS, TICK_COLUMNS,
)

TICK_DOUBLES = ("ltp", "bid1", "ask1")
TICK_LONGS = ("volume", "oi", "trade_qty", "bqty1", "aqty1", "cum_delta")


def remove_garbage_columns(df: DataFrame) -> DataFrame:
    return df.drop(*GARBAGE_COLUMNS)


def validate_columns(df: DataFrame, expected: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Keep the expected columns that exist; also return the missing names."""
    expected = BOOK_COLUMNS if expected is None else expected
    return (
        df.select(*[F.col(f"`{c}`") for c in expected if c in df.columns]),
        [c for c in expected if c not in df.columns],
    )


def validate_schema(df: DataFrame, expected: dict[str, str]) -> bool:
    """All named columns exist and their types start with the given prefix ('' = any)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return all(n in types and types[n].startswith(p) for n, p in expected.items())


def normalize_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, as_utc(ts)) if ts in df.columns else df


def book_type(name: str) -> str | None:
    """Target type by name prefix; None leaves the column as it is."""
    if name == "ts":
        return "timestamp"
    if name == "symbol":
        return "string"
    if "qty" in name:
        return "bigint"
    if name.startswith(("bid", "ask", "ltp")):
        return "double"
    return None


def tick_type(name: str) -> str | None:
    if name in TICK_LONGS:
        return "bigint"
    if name in TICK_DOUBLES:
        return "double"
    if name == "aggressor":
        return "string"
    return book_type(name) if name in ("ts", "symbol") else None


def _cast(df: DataFrame, rule) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c, to = F.col(f"`{field.name}`"), rule(field.name)
        floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        if floating:
            c = no_nan(c)
        if to == "bigint" and floating:
            c = F.round(c)
        out.append((c.cast(to) if to else c).alias(field.name))
    return df.select(*out)


def standardize_dtypes(df: DataFrame) -> DataFrame:
    return _cast(df, book_type)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Two passes: one aggregate over the data, then a projection.  One row reaches the driver.  A table without any
    value, as one without rows, keeps its columns: they are not known to be empty ones."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c] > 0]) if any(counts) else df


def valid_book(ask: str = "ask1", bid: str = "bid1") -> Column:
    return (F.col(ask) > F.col(bid)) & (F.col(bid) > 0) & (F.col(ask) > 0)


def has_key(ts: str = "ts", symbol: str = "symbol") -> Column:
    return F.col(ts).isNotNull() & F.col(symbol).isNotNull() & (F.col(symbol) != "")


def not_sentinel(symbol: str = "symbol") -> Column:
    return ~F.col(symbol).isin(*SENTINEL_SYMBOLS)


def equities_only(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    return df.where(is_equity(symbol))


def within_symbols(df: DataFrame, symbols: DataFrame, on: str = "symbol") -> DataFrame:
    """Semi-join with a symbol dimension; the planner broadcasts it while it is small."""
    return df.join(symbols.select(on).distinct(), on, "left_semi")


def date_window(df: DataFrame, start: str | None, end: str | None, day: str = "date") -> DataFrame:
    """Rows whose day text (either accepted format) lies in [start, end]."""
    when = parse_day(day)
    if start:
        df = df.where(when >= F.lit(start).cast("date"))
    if end:
        df = df.where(when <= F.lit(end).cast("date"))
    return df


def imbalance(bid_qty: str = "total_bid_qty", ask_qty: str = "total_ask_qty") -> Column:
    """b/(b+a) - a/(b+a); NULL when both are 0."""
    b, a = F.col(bid_qty).cast("double"), F.col(ask_qty).cast("double")
    total = F.nullif(b + a, F.lit(0.0))
    return b / total - a / total


def first_days(df: DataFrame, n: int, day: str = "trade_date") -> DataFrame:
    """Rows of the first n chronological days (the working set)."""
    days = df.select(day).distinct().orderBy(day).limit(n)
    return df.join(days, day, "left_semi")


def extract_trades(ticks: DataFrame) -> DataFrame:
    """Executed trades of a unified feed; an unknown aggressor counts as BUY."""
    side = F.upper(F.col("aggressor"))
    return ticks.where(F.col("trade_qty") > 0).select(
        *[c for c in ("symbol", "trade_date", "ts", "seq") if c in ticks.columns],
        F.col("ltp").cast("double").alias("trade_price"),
        F.col("trade_qty").cast("bigint").alias("trade_qty"),
        F.when(side.isin("BUY", "SELL"), side).otherwise(F.lit("BUY")).alias("direction"),
    )


def clean_book(df: DataFrame, session: bool = True, keep: tuple[str, ...] = (),
               observe: Observation | None = None) -> DataFrame:
    """Project, cast and filter book snapshots in one narrow pass over the scan.

    ``keep`` names extra columns to carry (row ids, partition columns).  Pass an Observation
    to obtain raw and clean row counts from the same job that writes the result.
    """
    df = remove_garbage_columns(df)
    extra = [c for c in keep if c in df.columns and c not in BOOK_COLUMNS]
    df, _ = validate_columns(df, BOOK_COLUMNS + extra)
    df = standardize_dtypes(df)
    ok = has_key()
    if {"ask1", "bid1"} <= set(df.columns):
        ok = ok & valid_book()
    if session:
        ok = ok & in_session("ts")
    if observe is not None:
        df = df.observe(observe, F.count(F.lit(1)).alias("raw_rows"),
                        F.count_if(F.coalesce(ok, F.lit(False))).alias("clean_rows"))
    return df.where(ok)


def clean_ticks(df: DataFrame, session: bool = True, keep: tuple[str, ...] = (),
                drop_empty: bool = True, observe: Observation | None = None) -> DataFrame:
    """Project, cast and filter ticks; columns that hold no value at all are dropped."""
    extra = [c for c in keep if c in df.columns and c not in TICK_COLUMNS]
    df, _ = validate_columns(df, TICK_COLUMNS + extra)
    if drop_empty:
        df = drop_all_null_columns(df)
    df = _cast(df, tick_type)
    ok = has_key()
    if session:
        ok = ok & in_session("ts")
    if observe is not None:
        df = df.observe(observe, F.count(F.lit(1)).alias("raw_rows"),
                        F.count_if(F.coalesce(ok, F.lit(False))).alias("clean_rows"))
    return df.where(ok)


def sort_for_write(df: DataFrame, by: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Order inside each partition only; a global sort buys nothing for a partitioned table."""
    return df.sortWithinPartitions(*[c for c in by if c in df.columns])


def with_trade_date(df: DataFrame, ts: str = "ts", tz: str | None = None) -> DataFrame:
    when = as_utc(ts) if tz is None else F.from_utc_timestamp(as_utc(ts), tz)
    return df.withColumn("trade_date", when.cast("date"))


