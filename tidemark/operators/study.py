"""Event studies and day-clustered comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.momentum import crosses, entry_cost_bps, first_event, next_bar_exits, roc
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.schema import KEYS
from tidemark.session import stage

PATTERNS = [
    ("single_long", "long_cross", "LONG"), ("single_short", "short_cross", "SHORT"),
    ("double_long", "long_double_cross", "LONG"), ("double_short", "short_double_cross", "SHORT"),
]


def study_bars(bars: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bars with roc_3 (NULL until known), crosses, next-bar entry and exits: one shuffle."""
    with_roc = bars.withColumn("roc_3", roc(3, keys=keys, fill=None))
    return next_bar_exits(crosses(with_roc, keys=keys), keys=keys)


def event_trades(prepared: DataFrame, patterns=PATTERNS, keys: tuple[str, ...] = KEYS,
                 groups: tuple[str, ...] = ()) -> DataFrame:
    """First event per (pattern, symbol, day): gross and net bps at +30, +60 bars and the close.

    ``groups`` are extra columns that separate events (for example a model flag).
    """
    tagged = prepared.withColumn("pattern", F.explode(F.filter(F.array(*[
        F.when(F.col(flag), F.struct(F.lit(name).alias("name"), F.lit(d).alias("direction")))
        for name, flag, d in patterns
    ]), lambda p: p.isNotNull())))
    tagged = tagged.withColumns({"direction": F.col("pattern.direction"), "pattern": F.col("pattern.name")})
    events = first_event(tagged, ("pattern", *groups, *keys)).where(
        F.col("entry_price").isNotNull() & (F.col("entry_price") > 0))
    sign = F.when(F.col("direction") == "LONG", F.lit(1.0)).otherwise(F.lit(-1.0))
    entry = F.col("entry_price")
    out = events.withColumn("cost_bps", entry_cost_bps("entry_ts"))
    for h in ("30m", "60m", "eod"):
        out = out.withColumn(f"gross_{h}", (F.col(f"exit_{h}") - entry) / entry * 10000.0 * sign)
        out = out.withColumn(f"net_{h}", F.col(f"gross_{h}") - F.col("cost_bps"))
    return out.select("pattern", "direction", *groups, *keys, "ts", "entry_ts", "entry_price", "cost_bps",
                      *[f"{k}_{h}" for h in ("30m", "60m", "eod") for k in ("gross", "net")])


def by_horizon(trades: DataFrame, carry: list[str]) -> DataFrame:
    """Long form: one row per trade and horizon."""
    return trades.select(*carry, F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"gross_{h}").alias("gross"), F.col(f"net_{h}").alias("net"))
        for h in ("30m", "60m", "eod")])).alias("r")).select(*carry, "r.*")


def event_study(trades: DataFrame) -> DataFrame:
    """Trade-level and day-level statistics per pattern and horizon."""
    long = stage(by_horizon(trades, ["pattern", "trade_date"]))
    group = ["pattern", "horizon"]
    # trades -> days -> totals: the second level sees one row per day
    days = long.groupBy(*group, "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gross").alias("g"), F.sum("net").alias("s"),
        F.sum(F.col("net") * F.col("net")).alias("s2"),
        F.count_if(F.col("net") > 0).alias("pos"), F.avg("net").alias("day_net"))
    spread = long.groupBy(*group).agg(F.stddev_samp("net").alias("std_net"))
    median = exact_quantiles(long, "net", [0.5], group).select(*group, F.col("q")[0].alias("median_net"))
    n_days = F.count(F.lit(1))
    sd = F.stddev_samp("day_net")
    total = days.groupBy(*group).agg(
        F.sum("n").cast("bigint").alias("trades"),
        (F.sum("g") / F.sum("n")).alias("mean_gross"), (F.sum("s") / F.sum("n")).alias("mean_net"),
        (F.sum("pos") * 100.0 / F.sum("n")).alias("pct_positive"),
        n_days.alias("days"), F.avg("day_net").alias("day_mean"), sd.alias("day_std"),
        F.when(sd > 0, F.avg("day_net") / (sd / F.sqrt(n_days))).alias("day_t"),
        F.count_if(F.col("day_net") > 0).alias("positive_days"),
    )
    return total.join(spread, group).join(median, group)


def clustered_t(samples: DataFrame, by: list[str], day: str = "trade_date", group: str = "grp",
                value: str = "value") -> DataFrame:
    """Group A against group B: pooled means and difference, mean of the daily differences over
    days both groups have, its t value and the number of positive days.

    One aggregate to (by, day) with map-side sums, then one over days; no join of the groups.
    """
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    days = samples.groupBy(*by, day).agg(
        *[F.sum(side(g)).alias(f"s_{g}") for g in "AB"], *[F.count(side(g)).alias(f"n_{g}") for g in "AB"])
    days = days.withColumn("diff", F.col("s_A") / F.nullif(F.col("n_A"), F.lit(0))
                           - F.col("s_B") / F.nullif(F.col("n_B"), F.lit(0)))
    n = F.count("diff")
    sd = F.stddev_samp("diff")
    mean = lambda g: F.sum(f"s_{g}") / F.nullif(F.sum(f"n_{g}"), F.lit(0))
    return days.groupBy(*by).agg(
        F.sum("n_A").cast("bigint").alias("n_a"), F.sum("n_B").cast("bigint").alias("n_b"),
        mean("A").alias("mean_a"), mean("B").alias("mean_b"), (mean("A") - mean("B")).alias("pooled_diff"),
        n.alias("days"), F.when(n > 1, F.avg("diff")).alias("day_diff"),
        F.when((n > 1) & (sd > 0), F.avg("diff") / (sd / F.sqrt(n))).alias("t_stat"),
        F.count_if(F.col("diff") > 0).alias("positive_days"),
    )


def flag_daily_top(bars: DataFrame, scores: dict[str, str], q: float = 0.99, day: str = "trade_date") -> DataFrame:
    """Flags bars at or above the day's q-quantile of a score; the quantile is an aggregate joined back."""
    limits = None
    for flag, score in scores.items():
        one = exact_quantiles(bars, score, [q], [day]).select(day, F.col("q")[0].alias(f"_lim_{flag}"))
        limits = one if limits is None else limits.join(one, day, "full")
    return bars.join(limits, day, "left").withColumns(
        {flag: F.coalesce(F.col(s) >= F.col(f"_lim_{flag}"), F.lit(False)) for flag, s in scores.items()}
    ).drop(*[f"_lim_{f}" for f in scores])


def overlay_ab(bars: DataFrame, keys: tuple[str, ...] = KEYS, q: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Cross events in the day's top probability (A) against the rest (B): (trades, comparison)."""
    bars = stage(bars)
    flagged = flag_daily_top(bars, {"top_long": "prob_long", "top_short": "prob_short"}, q)
    prepared = study_bars(flagged, keys)
    # each bar belongs to group A or B by the flag of the direction it signals
    parts = []
    for (name, flag, d), top in zip(PATTERNS[:2], ("top_long", "top_short")):
        part = prepared.withColumn("grp", F.when(F.col(top), "A").otherwise("B"))
        parts.append(event_trades(part, [(name, flag, d)], keys, groups=("grp",)))
    trades = stage(parts[0].unionByName(parts[1]))
    long = by_horizon(trades, ["pattern", "grp", "trade_date"]).withColumnRenamed("net", "value")
    return trades, clustered_t(long, ["pattern", "horizon"])


def daily_counts(events: DataFrame, by: list[str], day: str = "trade_date") -> DataFrame:
    """Events per active day: total, days, smallest, median, largest."""
    per_day = events.groupBy(*by, day).agg(F.count(F.lit(1)).alias("n"))
    # one row per trading day and group, so the exact percentile stays tiny
    return per_day.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("events"), F.count(F.lit(1)).alias("days"),
        F.min("n").alias("min_day"), F.percentile("n", F.lit(0.5)).alias("median_day"), F.max("n").alias("max_day"))


def numbered_days(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """day, day_no: the calendar dimension in order (one row per day)."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    return df.select(day).distinct().withColumn("day_no", F.row_number().over(w))
