"""Rule signals per symbol-day: decile, percentile and paired rules, oriented by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.schema import KEYS

# Rule inputs.
RULE_INPUTS = ["delta_1m", "delta_5m", "trade_count_burst", "volume_burst", "spread"]
PERCENTILE_INPUTS = ["trade_count_burst", "volume_burst", "spread"]
PAIRED_INPUTS = [
    ("delta_1m", "trade_count_burst"), ("delta_5m", "volume_burst"),
    ("trade_count_burst", "volume_burst"), ("trade_count_burst", "spread"),
]
QUANTILES = (0.1, 0.2, 0.8, 0.9)


def thresholds(bars: DataFrame, horizons: tuple[int, ...], features: list[str] = RULE_INPUTS,
               keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per group: quantiles of each feature and its correlation with each forward return.

    Groups are symbol-days of bars, so exact percentiles are bounded by the bars of one day.
    """
    return bars.groupBy(*keys).agg(
        *[F.percentile(f, F.array(*[F.lit(q) for q in QUANTILES])).alias(f"q_{f}") for f in features],
        *[_corr(f, f"return_{h}m").alias(f"c_{f}_{h}") for f in features for h in horizons],
    )


def _corr(x: str, y: str):
    """Pearson correlation; NULL where either side is constant or has fewer than two pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y))
    varied = (F.min(a) != F.max(a)) & (F.min(b) != F.max(b))
    return F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def rule_signals(bars: DataFrame, horizons: tuple[int, ...] = (30, 60, 120), label_pct: int = 3,
                 features: list[str] = RULE_INPUTS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per (bar, rule, horizon) whose rule holds.

    All rules of a bar are evaluated as one array and exploded, so the bars are read once
    however many rules there are.
    """
    t = bars.join(thresholds(bars, horizons, features, keys), list(keys))
    q = lambda f, i: F.col(f"q_{f}")[i]
    rows = []

    def rule(h, feature, name, test, high=None, low=None):
        rows.append(F.when(test, F.struct(
            F.lit(h).cast("bigint").alias("horizon"), F.lit(feature).alias("feature"),
            name.alias("rule_name") if not isinstance(name, str) else F.lit(name).alias("rule_name"),
            F.col(f"return_{h}m").alias("forward_return"), F.col(f"label_{h}m_{label_pct}pct").alias("label"),
            (high if high is not None else F.lit(None).cast("double")).alias("threshold_high"),
            (low if low is not None else F.lit(None).cast("double")).alias("threshold_low"))))

    for h in horizons:
        for f in features:
            c, top, bottom = F.col(f"c_{f}_{h}"), q(f, 3), q(f, 0)
            known = c.isNotNull()
            rule(h, f, F.when(c >= 0, "top_decile_long").otherwise("top_decile_short"), known & (F.col(f) >= top), high=top)
            rule(h, f, F.when(c >= 0, "bottom_decile_short").otherwise("bottom_decile_long"),
                 known & (F.col(f) <= bottom), low=bottom)
        for f in PERCENTILE_INPUTS:
            rule(h, f, "thresh_>=90pct", F.col(f) >= q(f, 3), high=q(f, 3))
            rule(h, f, "thresh_>=80pct", F.col(f) >= q(f, 2), high=q(f, 2))
            rule(h, f, "thresh_<=10pct", F.col(f) <= q(f, 0), low=q(f, 0))
            rule(h, f, "thresh_<=20pct", F.col(f) <= q(f, 1), low=q(f, 1))
        for a, b in PAIRED_INPUTS:
            # a constant input has no correlation and takes the lower tail
            side = lambda f: F.when(F.coalesce(F.col(f"c_{f}_{h}") >= 0, F.lit(False)), F.col(f) >= q(f, 3)).otherwise(F.col(f) <= q(f, 0))
            rule(h, f"{a}+{b}", "top_decile_and", side(a) & side(b))
    held = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return t.withColumn("r", F.explode(held)).select(
        *keys, "ts", F.col("ltp").alias("entry_price"), *features, "r.*")
