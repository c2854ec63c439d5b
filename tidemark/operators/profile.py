"""Audits and profiles: duplicates, nulls, time-zone sanity, dataset profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import as_utc, floor_to, micros


def duplicate_audit(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows beyond the first of each group of equal rows (counted, never dropped)."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls: one scan, one row per column."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return one.select(F.explode(pairs).alias("p")).select("p.column", "p.nulls")


def tz_sanity(df: DataFrame, label: str = "clean", ts: str = "ts") -> DataFrame:
    """Three rules on the hour of naive times: range (error), local-looking median, odd range (warnings)."""
    stats = df.agg(
        F.min(F.hour(as_utc(ts))).alias("lo"),
        F.max(F.hour(as_utc(ts))).alias("hi"),
        F.percentile(F.hour(as_utc(ts)), F.lit(0.5)).alias("mid"),
    )
    rules = F.array(
        _rule("hour_range", "ERROR", (F.col("lo") < 0) | (F.col("hi") >= 24)),
        _rule("median_in_local_session", "WARN", F.col("mid").between(9, 16)),
        _rule("outside_utc_band", "WARN", (F.col("lo") < 2) | (F.col("hi") > 22)),
    )
    return stats.select(
        F.lit(label).alias("label"), F.col("lo").cast("bigint").alias("hour_min"),
        F.col("hi").cast("bigint").alias("hour_max"), F.col("mid").alias("hour_median"),
        F.explode(rules).alias("r"),
    ).select("label", "hour_min", "hour_max", "hour_median", "r.rule", "r.severity", "r.fired")


def _rule(name, severity, fired):
    return F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"),
                    F.coalesce(fired, F.lit(False)).alias("fired"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, non_null_pct, min, max, mean, std for every numeric column, in one scan."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    stats = []
    for c in numeric:
        x = F.col(f"`{c}`").cast("double")
        stats.append(F.struct(
            F.lit(c).alias("column"),
            (F.count(x) * 100.0 / F.count(F.lit(1))).alias("non_null_pct"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def time_profile(df: DataFrame, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", seq: str = "seq",
                 chunk: int = 1_000_000) -> DataFrame:
    """Per key: rows, first/last time, out-of-order rows (in ``seq`` order), repeated times,
    smallest non-zero gap.

    The previous row is found inside blocks of ``chunk`` consecutive ``seq`` values; only the
    first and last row of each block take part in a second, small window that joins the
    blocks.  A key that holds most of the rows is therefore spread over many tasks.
    """
    block = F.floor(F.col(seq) / F.lit(chunk))
    inner = Window.partitionBy(*keys, "block").orderBy(seq)
    staged = (
        df.select(*keys, F.col(seq).alias(seq), micros(ts).alias("us"), block.alias("block"))
        .withColumn("prev", F.lag("us").over(inner))
        .withColumn("last", F.lead("us").over(inner).isNull())
        .withColumn("edge", F.col("prev").isNull() | F.col("last"))
        .withColumn("grp", F.when(~F.col("edge"), F.col("block")))
    )
    outer = Window.partitionBy(*keys, "grp").orderBy(seq)
    gap = F.col("us") - F.coalesce("prev", F.when(F.col("edge"), F.lag("us").over(outer)))
    gaps = staged.withColumn("gap", gap)
    # equal times are counted per (key, time) first: a second partial aggregate, no window
    per_time = gaps.groupBy(*keys, "us").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gap") < 0).alias("ooo"),
        F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap"),
    )
    return per_time.groupBy(*keys).agg(
        F.sum("n").cast("bigint").alias("rows"),
        F.timestamp_micros(F.min("us")).alias("first_ts"),
        F.timestamp_micros(F.max("us")).alias("last_ts"),
        F.sum("ooo").cast("bigint").alias("out_of_order"),
        (F.sum("ooo") == 0).alias("monotonic"),
        F.sum(F.col("n") - 1).cast("bigint").alias("duplicate_ts"),
        F.min("gap").alias("min_gap_us"),
    )


def coverage_audit(stages: dict[str, DataFrame], day: str = "trade_date", symbol: str = "symbol") -> DataFrame:
    """Symbols per day at every stage; a day is OK when each stage has rows, else BLIND."""
    tables = [
        df.groupBy(day).agg(F.countDistinct(symbol).alias(f"{name}_symbols"))
        for name, df in stages.items()
    ]
    joined = reduce(lambda a, b: a.join(b, day, "full"), tables)
    names = [f"{n}_symbols" for n in stages]
    out = joined.select(day, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    covered = reduce(lambda a, b: a & b, [F.col(n) > 0 for n in names])
    return out.withColumn("status", F.when(covered, "OK").otherwise("BLIND"))


def bars_per_day(bars: DataFrame, ts: str = "ts", bar: str = "1 minute") -> DataFrame:
    """Distinct bar times per (symbol, day)."""
    return bars.groupBy("symbol", "trade_date").agg(
        F.countDistinct(floor_to(ts, bar)).alias("bars"))


def bar_count_pivot(bars: DataFrame, ts: str = "ts", bar: str = "1 minute") -> DataFrame:
    """Bars per symbol with one column for each day of the data (dYYYY_MM_DD), 0 where a symbol has none."""
    counts = bars_per_day(bars, ts, bar).withColumn("day", F.date_format("trade_date", "'d'yyyy_MM_dd"))
    return counts.groupBy("symbol").pivot("day").agg(F.sum("bars")).na.fill(0)
