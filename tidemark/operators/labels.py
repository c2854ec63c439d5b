"""Forward returns and class labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time
from tidemark.operators.schema import KEYS, LABEL_HORIZONS, LABEL_THRESHOLDS


def label_name(horizon: int, threshold: float) -> str:
    return f"label_{horizon}m_{int(threshold * 100)}pct"


def forward_return(horizon: int, price: str = "ltp", keys: tuple[str, ...] = KEYS) -> Column:
    """Return over the next ``horizon`` rows; NULL near the end of the group."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return (F.lead(price, horizon).over(w) - F.col(price)) / F.nullif(F.col(price), F.lit(0.0))


def assign_label(ret: Column, threshold: float) -> Column:
    return (
        F.when(ret.isNull(), F.lit(None).cast("string"))
        .when(ret <= -threshold, "SHORT").when(ret >= threshold, "LONG").otherwise("NO_TRADE")
    )


def label_matrix(bars: DataFrame, horizons=LABEL_HORIZONS, thresholds=LABEL_THRESHOLDS,
                 price: str = "ltp", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """return_{h}m and label_{h}m_{t}pct for every horizon and threshold; one shuffle in all."""
    out = bars.withColumns({f"return_{h}m": forward_return(h, price, keys) for h in horizons})
    return out.withColumns({
        label_name(h, t): assign_label(F.col(f"return_{h}m"), t) for h in horizons for t in thresholds
    })


def label_summary(labeled: DataFrame, horizons=LABEL_HORIZONS, thresholds=LABEL_THRESHOLDS) -> DataFrame:
    """Count and percentage of each label per configuration, in long form, from one scan."""
    configs = [(h, t, label_name(h, t)) for h in horizons for t in thresholds
               if label_name(h, t) in labeled.columns]
    long = labeled.select(F.explode(F.array(*[
        F.struct(F.lit(h).cast("bigint").alias("horizon"), F.lit(float(t)).alias("threshold"),
                 F.lit(n).alias("label_column"), F.col(n).alias("label"))
        for h, t, n in configs
    ])).alias("r")).select("r.*")
    counts = long.groupBy("horizon", "threshold", "label_column", "label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("horizon", "threshold", "label_column")
    total = F.sum("n").over(w)
    available = F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(w), F.lit(0))
    return (
        counts.withColumn("total_rows", total).withColumn("available", available)
        .withColumn("unavailable", F.col("total_rows") - F.col("available"))
        .where("label IS NOT NULL")
        .withColumn("pct", F.col("n") * 100.0 / F.col("available"))
    )


def feature_by_label(labeled: DataFrame, label: str, features: list[str]) -> DataFrame:
    return labeled.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])


def _power(k: Column) -> Column:
    return F.pow(F.lit(2.0), k).cast("int")


def first_touch_label(bars: DataFrame, threshold: float = 0.015, price: str = "ltp", cutoff: str = "15:00:00",
                      keys: tuple[str, ...] = KEYS) -> DataFrame:
    """LONG / SHORT by which barrier a later bar of the day touches first, else NO_TRADE.

    Barriers are relative to each bar's own price.  A day is one array of at most one element per bar
    time.  Extremes of 1, 2, 4 ... bars from each bar on are tabulated once, and the first touch is found by
    halving steps: n log n for a day of n bars.  Its bars get back only the two times.
    """
    live = bars.where(exchange_time("ts") < cutoff)
    point = F.struct(F.col("ts").cast("timestamp").alias("t"), F.col(price).cast("double").alias("p"))
    days = live.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("_path")).withColumn("_n", F.size("_path"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(2)))).cast("int"))

    def table(further):
        """The extremes of 2**k bars from each bar on, by k; fewer at the end of the day."""
        def twice(levels, k):
            last = F.element_at(levels, -1)
            return F.concat(levels, F.array(F.transform(last, lambda x, i: further(x, F.get(last, i + _power(k))))))
        return F.aggregate(steps, F.array(F.transform("_path", lambda x: x["p"])), twice)

    tables = days.select(*keys, "_path", "_n", F.explode(F.array(F.struct(table(F.greatest).alias("most"), table(F.least).alias("least")))).alias("_x"),
                         F.reverse(steps).alias("_steps"))

    def first_at(i, name, beyond):
        """Leap over runs of bars that do not touch, longest first; the place behind them touches, if there is one."""
        levels = F.col(f"_x.{name}")
        at = F.aggregate("_steps", i + 1, lambda at, k: F.when(
            (at < F.col("_n")) & ~beyond(F.get(F.get(levels, k), at)), F.least(at + _power(k), F.col("_n"))).otherwise(at))
        return F.get("_path", at)["t"]

    touched = tables.select(*keys, F.explode(F.transform("_path", lambda x, i: F.struct(
        x["t"].alias("_at"), first_at(i, "most", lambda p: p >= x["p"] * (1 + threshold)).alias("up_ts"),
        first_at(i, "least", lambda p: p <= x["p"] * (1 - threshold)).alias("down_ts")))).alias("_touch")).select(*keys, "_touch.*")
    up, down = F.col("up_ts"), F.col("down_ts")
    met = live.withColumn("_at", F.col("ts").cast("timestamp")).join(touched.dropDuplicates([*keys, "_at"]), [*keys, "_at"]).drop("_at")
    return met.withColumn(
        "first_touch", F.when(up.isNotNull() & (down.isNull() | (up < down)), "LONG")
        .when(down.isNotNull(), "SHORT").otherwise("NO_TRADE"))
