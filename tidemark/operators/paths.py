"""Forward price paths of signals, matched controls and lift.

A signal needs the rest of its own symbol-day.  For the days that have signals, running windows
from the end of the day give every bar the extremes, their places and the returns of what comes
from it on; a signal takes those of the first bar after it by an equi-join.  No signal is ever
multiplied by its later bars, and no day or set of candidates is gathered into an array.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ranks import MEAN, exact_quantiles, top_fraction
from tidemark.operators.schema import KEYS
from tidemark.session import stage

METRICS = ["mfe_bps", "mfe_minute", "mae_bps", "mae_minute", "mae_before_mfe_bps",
           "ret_60m_bps", "ret_eod_bps", "bars_to_close"]
VARIANCE_METRICS = ["abs_ret_60m_bps", "abs_ret_eod_bps", "realized_var_60m"]


def suffix_facts(bars: DataFrame, direction: str, high: str, low: str, close: str, horizon: int, keys: tuple[str, ...]) -> DataFrame:
    """keys, _rn and what comes from each bar on, itself included, in its day: best and worst value with their places, the
    worst until the best, closes after ``horizon`` bars and at the end, bars left, and squared log steps.

    Values are signed so that more is better.  The first best value of what comes after a bar is the same for all bars
    before it back to the one before it: they form a run, within which the worst value until it is a running minimum.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    best, worst = (F.col(high), F.col(low)) if direction == "LONG" else (-F.col(low), -F.col(high))
    day = Window.partitionBy(*keys)
    out = bars.select(*keys, F.row_number().over(day.orderBy(t)).alias("_rn"), best.cast("double").alias("_b"), worst.cast("double").alias("_w"),
                      F.col(close).cast("double").alias("_c"))
    order = day.orderBy("_rn")
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    step = F.pow((F.log("_c") - F.log(F.lag("_c").over(order))) * 10000.0, F.lit(2.0))
    out = out.withColumn("_v", F.coalesce(step, F.lit(0.0)))
    out = out.withColumns({
        "_top": F.max(F.when(F.col("_b").isNotNull(), F.struct("_b", -F.col("_rn")))).over(onward),
        "_bottom": F.min(F.when(F.col("_w").isNotNull(), F.struct("_w", "_rn"))).over(onward),
        "_left": F.count(F.lit(1)).over(onward), "_end": F.last("_c").over(onward), "_ahead": F.lead("_c", horizon - 1).over(order),
        "_steps": F.sum("_v").over(order.rowsBetween(1, horizon - 1)) if horizon > 1 else F.lit(0.0),
    }).withColumns({"_best": F.col("_top._b"), "_best_rn": -F.col("_top.col2"), "_worst": F.col("_bottom._w"), "_worst_rn": F.col("_bottom._rn")})
    run = Window.partitionBy(*keys, "_best_rn").orderBy("_rn").rowsBetween(0, Window.unboundedFollowing)
    return out.withColumn("_until", F.min("_w").over(run)).select(
        *keys, "_rn", "_best", "_worst", "_until", "_left", "_end", "_c", F.coalesce("_steps", F.lit(0.0)).alias("_steps"),
        F.when(F.col("_left") >= horizon, F.col("_ahead")).otherwise(F.col("_end")).alias("_at_h"),
        (F.col("_best_rn") - F.col("_rn") + 1).cast("bigint").alias("_best_no"), (F.col("_worst_rn") - F.col("_rn") + 1).cast("bigint").alias("_worst_no"))


def next_bar(signals: DataFrame, bars: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Signals with _rn: the number of the first bar of their day that is strictly later."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    both = bars.select(*keys, t.alias("_t"), F.lit(1).alias("_bar"), F.lit(None).cast(_nullable(signals)).alias("_signal")).unionByName(
        signals.select(*keys, t.alias("_t"), F.lit(0).alias("_bar"), F.struct(*signals.columns).alias("_signal")))
    upto = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    passed = both.withColumn("_rn", (F.sum("_bar").over(upto) + 1).cast("int")).where("_bar = 0")
    return passed.select("_signal.*", "_rn")


def _nullable(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])


def excursions(signals: DataFrame, bars: DataFrame, direction: str = "LONG", entry: str = "close_price",
               high: str = "high_price", low: str = "low_price", close: str = "close_price",
               horizon: int = 60, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Best and worst move strictly after the entry bar, when they came, the worst move before the
    best one, returns after ``horizon`` bars and at the end of the day, and realised variance.
    Signals on the last bar of a day have no path and are dropped."""
    p = F.col(entry)
    s = 1.0 if direction == "LONG" else -1.0
    days = bars.join(signals.select(*keys).distinct(), list(keys), "left_semi")
    facts = suffix_facts(days, direction, high, low, close, horizon, keys)
    out = next_bar(signals, days, keys).join(facts, [*keys, "_rn"])
    move = lambda x: (x - p) / p * (10000.0 * s)
    signed = lambda name: move(F.col(name) * s)  # best and worst are signed
    first = F.coalesce(F.pow((F.log("_c") - F.log(p.cast("double"))) * 10000.0, F.lit(2.0)), F.lit(0.0))
    out = out.withColumns({
        "mfe_bps": signed("_best"), "mae_bps": signed("_worst"), "mfe_minute": F.col("_best_no"), "mae_minute": F.col("_worst_no"),
        "mae_before_mfe_bps": signed("_until"), "ret_60m_bps": move(F.col("_at_h")), "ret_eod_bps": move(F.col("_end")),
        "bars_to_close": F.col("_left").cast("bigint"), "realized_var_60m": first + F.col("_steps")})
    return out.withColumns({
        "abs_ret_60m_bps": F.abs("ret_60m_bps"), "abs_ret_eod_bps": F.abs("ret_eod_bps"),
    }).drop("_rn", *[c for c in facts.columns if c not in keys])


def excursion_distribution(moves: DataFrame, by: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """metric, n, mean, p5, p25, p50, p75, p95 in long form."""
    by = list(by or [])
    metrics = metrics or METRICS
    long = moves.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("r")).select(*by, "r.*")
    group = [*by, "metric"]
    q = exact_quantiles(long, "value", [0.05, 0.25, 0.5, 0.75, 0.95], group, more={"mean": MEAN})
    return q.select(
        *group, "n", F.round("mean", 2).alias("mean"),
        *[F.round(F.col("q")[i], 2).alias(name) for i, name in enumerate(["p5", "p25", "p50", "p75", "p95"])])


def excursion_diagnostics(moves: DataFrame, by: list[str]) -> DataFrame:
    """Give-back gap between median best and median final move, and the MFE/MAE ratio."""
    names = {"mfe_bps": "med_mfe", "ret_eod_bps": "med_eod", "mae_bps": "med_mae"}
    long = moves.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("r")).select(*by, "r.*")
    q = exact_quantiles(long, "value", [0.5], [*by, "metric"])
    t = q.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("q")[0])).alias(a) for m, a in names.items()])
    gap = F.col("med_mfe") - F.col("med_eod")
    return t.select(
        *by, gap.alias("giveback_bps"),
        F.when(F.col("med_mfe") > 0, gap / F.col("med_mfe") * 100).otherwise(F.lit(0.0)).alias("giveback_pct"),
        F.when(F.abs("med_mae") > 0, F.col("med_mfe") / F.abs("med_mae")).otherwise(F.lit(0.0)).alias("mfe_mae_ratio"),
    )


class Draw(NamedTuple):
    """Order of the controls, and where in it a signal begins: both from ids, repeatable on any cluster."""
    order: Callable[[Column], Column]
    begin: Callable[[Column], Column]


class PairDraw(NamedTuple):
    """Order in which a signal takes its candidates, from both ids: each signal ranks all of them anew."""
    order: Callable[[Column, Column], Column]


def seeded_draw(seed: int = 42) -> Draw:
    return Draw(lambda control: F.xxhash64(F.lit(seed), control), lambda signal: F.pmod(F.xxhash64(F.lit(seed + 1), signal), F.lit(1 << 40)))


def matched_controls(signals: DataFrame, pool: DataFrame, match: list[str], fallback: list[str] | None = None,
                     n: int = 20, draw: Draw | PairDraw | None = None, signal_id: Column | None = None,
                     control_id: Column | None = None, carry: tuple[str, ...] = ("symbol", "ts", "close_price"),
                     loud: DataFrame | None = None) -> DataFrame:
    """Up to ``n`` control bars per signal, drawn without replacement from symbols that never signal
    (by default, that have none of ``signals``; else none of ``loud``).

    Controls of a match key stand in a seeded order; a signal takes the ``n`` places from its own
    beginning on, around the end.  Only the places are made for each signal, and they meet the controls
    in an equi-join on key and place.  With a ``PairDraw``, every signal meets all controls of its key, one per
    symbol at most, and takes the first ``n`` of its own order.  A signal without an exact match falls back to the coarser key.
    """
    draw = draw or seeded_draw()
    sid = signal_id if signal_id is not None else F.concat_ws("|", "symbol", F.col("ts").cast("string"))
    cid = control_id if control_id is not None else F.concat_ws("|", "symbol", F.col("ts").cast("string"))
    quiet = pool.join((signals if loud is None else loud).select("symbol").distinct(), "symbol", "left_anti").withColumn("_cid", cid)

    def drawn(asking: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        """Controls of the signals that have some, and the signals that have none."""
        # at most one control per symbol and key, since a symbol has one bar per bar time
        place = F.row_number().over(Window.partitionBy(*on).orderBy(draw.order(F.col("_cid")), "_cid")) - 1
        placed = quiet.select(*on, place.alias("_place"), F.struct(*carry).alias("_control"))
        sizes = quiet.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
        sized = asking.join(sizes, on, "left")
        turns = F.sequence(F.lit(0), F.least(F.lit(n), F.col("_size").cast("int")) - 1)
        places = sized.where(F.col("_size") > 0).select("_sid", "trade_date", *[c for c in on if c != "trade_date"], "_size", F.explode(turns).alias("_turn"))
        places = places.withColumn("_place", F.pmod(draw.begin(F.col("_sid")) + F.col("_turn"), F.col("_size")).cast("int"))
        return places.join(placed, [*on, "_place"]).select("_sid", "trade_date", "_turn", "_control"), sized.where("_size IS NULL").drop("_size")

    def ranked(asking: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
        """The same, by each signal's own order."""
        pairs = asking.select("_sid", "trade_date", *[c for c in on if c != "trade_date"]).join(
            quiet.select(*on, "_cid", F.struct(*carry).alias("_control")), on)
        turn = F.row_number().over(Window.partitionBy("_sid").orderBy(draw.order(F.col("_sid"), F.col("_cid")), "_cid")) - 1
        return (pairs.withColumn("_turn", turn).where(F.col("_turn") < n).select("_sid", "trade_date", "_turn", "_control"),
                asking.join(quiet.select(*on).distinct(), on, "left_anti"))

    taken = ranked if isinstance(draw, PairDraw) else drawn
    found, alone = taken(signals.withColumn("_sid", sid), list(match))
    if fallback:
        found = found.unionByName(taken(alone, list(fallback))[0])
    return found.select(F.col("_sid").alias("signal_id"), "trade_date", (F.col("_turn") + 1).cast("bigint").alias("draw_no"),
                        *[F.col(f"_control.{c}").alias(c) for c in carry])


def long_metrics(moves: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """trade_date, grp, metric, value."""
    return moves.select("trade_date", F.lit(group).alias("grp"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])).alias("r")).select("trade_date", "grp", "r.*")


def control_lift(bars: DataFrame, score: str, direction: str = "LONG", fraction: float = 0.001,
                 n_controls: int = 20, match: tuple[str, ...] = ("trade_date", "minute_of_day"),
                 fallback: tuple[str, ...] | None = None, metrics: list[str] | None = None,
                 draw: Draw | None = None, signal_id: Column | None = None,
                 control_id: Column | None = None) -> DataFrame:
    """Signals against matched controls: pooled means, day-clustered difference and t per metric.

    A signal on the last bar of its day has no path: it counts in neither group and draws no controls.
    """
    from tidemark.operators.study import clustered_t

    metrics = metrics or METRICS[:-1]
    bars = bars.withColumn("minute_of_day", F.date_format(F.col("ts").cast("timestamp"), "HH:mm"))
    bars = stage(bars)  # read by the ranking, the control pool and both sets of paths
    signals = stage(top_fraction(bars, score, fraction, ["symbol", "ts"]).drop("rn", "n"))
    last = bars.groupBy(*KEYS).agg(F.max("ts").alias("_last"))
    followed = signals.join(last, list(KEYS)).where(F.col("ts") < F.col("_last")).drop("_last")
    controls = matched_controls(followed, bars, list(match), list(fallback) if fallback else None, n_controls,
                                draw, signal_id, control_id, loud=signals)
    moves = lambda s: excursions(s, bars, direction)
    both = long_metrics(moves(signals), "A", metrics).unionByName(long_metrics(moves(controls), "B", metrics))
    return clustered_t(both, ["metric"])
