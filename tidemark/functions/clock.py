"""Time expressions.  Stored time is UTC; exchange rules are in exchange-local time."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGE_TZ = "Asia/Kolkata"
SESSION_OPEN = "09:15:00"
SESSION_CLOSE = "15:30:00"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
_NAMED = {"1 second": "second", "1 minute": "minute", "1 hour": "hour", "1 day": "day"}


def seconds_of(interval: str) -> int:
    """'15 minutes' -> 900."""
    found = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", interval)
    if not found:
        raise ValueError(f"unsupported interval: {interval!r}")
    return int(found.group(1)) * _UNIT_SECONDS[found.group(2)]


def as_utc(ts: Column | str) -> Column:
    """Naive, aware or text time to a UTC timestamp."""
    return _col(ts).cast("timestamp")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(as_utc(ts))


def floor_to(ts: Column | str, interval: str) -> Column:
    """Start of the fixed-width bucket that holds ``ts`` (UTC aligned)."""
    named = _NAMED.get(interval.strip())
    if named:
        return F.date_trunc(named, as_utc(ts))
    width = F.lit(seconds_of(interval) * 1_000_000)
    return F.timestamp_micros(micros(ts) - F.pmod(micros(ts), width))


def naive(ts: Column | str) -> Column:
    return _col(ts).cast("timestamp_ntz")


def exchange_time(ts: Column | str, pattern: str = "HH:mm:ss", tz: str = EXCHANGE_TZ) -> Column:
    """Exchange-local clock text of a UTC time."""
    return F.date_format(F.from_utc_timestamp(as_utc(ts), tz), pattern)


def in_session(ts: Column | str, opens: str = SESSION_OPEN, closes: str = SESSION_CLOSE,
               closed_end: bool = False, tz: str = EXCHANGE_TZ) -> Column:
    clock = exchange_time(ts, "HH:mm:ss.SSSSSS", tz)
    upper = clock <= F.lit(closes + ".000000") if closed_end else clock < F.lit(closes + ".000000")
    return (clock >= F.lit(opens + ".000000")) & upper


def slug(symbol: Column | str, day: Column | str) -> Column:
    """Display key SYM_DD_Mon_YY."""
    return F.concat_ws("_", F.upper(_col(symbol)), F.date_format(_col(day), "dd_MMM_yy"))


def parse_day(text: Column | str) -> Column:
    """'11_Jun_26' or '2026-06-11' to DATE; anything else is NULL."""
    trimmed = F.trim(_col(text).cast("string"))
    return F.coalesce(
        F.try_to_timestamp(trimmed, F.lit("dd_MMM_yy")),
        F.try_to_timestamp(trimmed, F.lit("yyyy-MM-dd")),
    ).cast("date")


def order_key(ts: Column | str, seq: Column | str | None = None) -> Column:
    """One sortable number per (ts, seq).

    A primitive or decimal ordering keeps min_by / max_by inside HashAggregate; a struct
    ordering would turn the map-side combine into a sort of the raw rows.
    """
    if seq is None:
        return micros(ts)
    return F.expr(
        f"CAST(unix_micros(CAST({ts} AS timestamp)) AS DECIMAL(18,0)) "
        f"* CAST(10000000000000000000 AS DECIMAL(20,0)) + CAST({seq} AS DECIMAL(19,0))"
    )


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
