"""Scalar expressions: guarded division, hashing, text parsing, symbol classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, ``default`` where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(default).cast("double"))


def add_all(cols: list[Column | str]) -> Column:
    """Sum that skips NULLs; 0 for an empty list."""
    parts = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols]
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def no_nan(x: Column | str) -> Column:
    """NaN to NULL for floating columns."""
    return F.when(~F.isnan(col(x)), col(x))


def md5_fold(key: Column | str, folds: int = 5) -> Column:
    """md5(key) as a 128-bit number modulo ``folds``.

    The digest is read as four 32-bit words w1..w4, so the number is
    ((w1*2^32 + w2)*2^32 + w3)*2^32 + w4; the running remainder stays far below 2^63.
    """
    digest = F.md5(F.upper(col(key)).cast("binary"))
    rest = F.lit(0).cast("bigint")
    for part in range(4):
        word = F.conv(F.substring(digest, part * 8 + 1, 8), 16, 10).cast("bigint")
        rest = (rest * F.lit((1 << 32) % folds) + word) % F.lit(folds)
    return rest.cast("int")


def percent_value(text: Column | str) -> Column:
    """'12.5%' -> 0.125, '0.3' -> 0.3, blank or junk -> 0."""
    t = F.trim(col(text).cast("string"))
    bare = F.regexp_replace(t, "%$", "").try_cast("double")
    value = F.when(t.endswith("%"), bare / 100.0).otherwise(t.try_cast("double"))
    return F.coalesce(value, F.lit(0.0))


def pair_thresholds(label: Column | str) -> tuple[Column, Column]:
    """'L25_S30' -> (0.25, 0.30)."""
    text = F.upper(col(label))
    pull = lambda g: F.nullif(F.regexp_extract(text, r"L(\d+)_S(\d+)", g), F.lit("")).cast("int") / 100.0
    return pull(1), pull(2)


# Index names that are not single equities.
INDEX_SYMBOLS = ("NIFTY", "BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "SENSEX")


def is_equity(symbol: Column | str) -> Column:
    """Drops indices, futures, options and bare numeric ids."""
    s = col(symbol)
    return (
        ~s.isin(*INDEX_SYMBOLS)
        & ~F.upper(s).rlike("-(FUT|CE|PE)")
        & ~s.rlike(r"^\d+$")
    )
