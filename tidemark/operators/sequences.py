"""Double-momentum sequences over bars and the trades they open.

Per (symbol, day, direction, threshold pair): the first bar whose probability reaches the
threshold; then the first later bar with momentum at or beyond the mark; then the first later
bar back under it; then the first later bar beyond it again (the trigger).  A symbol-day is
gathered once and all steps are found in one pass over its array, so the bars are shuffled once and
never multiplied by the parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time, slug
from tidemark.functions.scalars import pair_thresholds
from tidemark.operators.momentum import ROC_THRESHOLD
from tidemark.operators.schema import KEYS

# Swept threshold pairs.
THRESHOLD_PAIRS = [
    "L20_S30", "L25_S30", "L28_S30", "L30_S30",
    "L20_S25", "L25_S25", "L28_S25", "L30_S25",
    "L28_S28", "L15_S15", "L20_S20",
]
ENTRY_CUTOFF = "15:00:00"
TAKE_PROFIT = 0.10
BYPASS_PROB = 0.35

STRATEGY_COLUMNS = [
    "pair", "slug", "symbol", "trade_date", "direction",
    "max_prob_long", "max_prob_short", "max_prob_time", "theta_caught_time",
    "open", "close", "high", "low", "intraday_range_pct",
    "mark1_ts", "between_ts", "max_stage", "rejection_reason",
    "entry_time_ist", "entry_price", "exit_price",
    "eod_pnl_pct", "mfe_pct", "mae_pct", "roc_at_entry",
    "daily_open_passed", "bypass_used",
    "delta_value_lakhs_at_theta", "delta_value_lakhs_at_max_prob",
]


def pair_table(spark, labels: list[str] | None = None) -> DataFrame:
    """pair, direction, theta: two rows per label."""
    one = spark.createDataFrame([(p,) for p in (labels or THRESHOLD_PAIRS)], "pair string")
    long_th, short_th = pair_thresholds("pair")
    return one.select("pair", F.explode(F.array(
        F.struct(F.lit("LONG").alias("direction"), long_th.alias("theta")),
        F.struct(F.lit("SHORT").alias("direction"), short_th.alias("theta")),
    )).alias("t")).select("pair", "t.*")


def day_metrics(bars: DataFrame, keys: tuple[str, ...] = KEYS, extra: tuple = ()) -> DataFrame:
    """Open, close, high, low and range of each symbol-day, with ``extra`` aggregates beside them."""
    order = F.unix_micros(F.col("ts").cast("timestamp"))
    return bars.groupBy(*keys).agg(
        *extra,
        F.coalesce(F.min_by("open_price", order), F.min_by("ltp", order)).alias("open"),
        F.max_by("ltp", order).alias("close"), F.max("ltp").alias("high"), F.min("ltp").alias("low"),
    ).withColumn("intraday_range_pct", (F.col("high") - F.col("low")) / F.col("low") * 100)


#: Stages of the walk over a day: waiting for the four steps, in the trade, out of it.
_IN_TRADE, _OUT = 4, 5
_STEPS = ("theta", "mark1", "between", "trigger")


def _walk(theta: Column, is_long: Column, threshold: float) -> Column:
    """One pass over a day: row numbers of the steps and of the exit, highest and lowest price in between.

    The exit is the first bar from the trigger on that is at or behind the cutoff, else the last bar."""
    def stepped(at: Column, x: Column) -> Column:
        bar, stage = x["b"], at["stage"]
        prob = F.when(is_long, bar["prob_long"]).otherwise(bar["prob_short"])
        move = F.when(is_long, bar["roc"]).otherwise(-bar["roc"])
        hit = (F.when(stage == 0, prob >= theta).when(stage.isin(1, 3), move >= threshold).when(stage == 2, move < threshold))
        enters = F.coalesce(hit, F.lit(False))
        inside = (stage == _IN_TRADE) | ((stage == _IN_TRADE - 1) & enters)
        onward = F.when(inside & (bar["clock"] >= ENTRY_CUTOFF), _OUT).when(enters, stage + 1).otherwise(stage)
        now = lambda name, value: F.when(inside, value).otherwise(at[name]).alias(name)
        return F.struct(onward.alias("stage"),
                        *[F.when(enters & (stage == i), x["rn"]).otherwise(at[name]).alias(name) for i, name in enumerate(_STEPS)],
                        now("exit", x["rn"]), now("high", F.greatest(at["high"], bar["ltp"])), now("low", F.least(at["low"], bar["ltp"])))

    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    start = F.struct(F.lit(0).alias("stage"), *[none(n, "int") for n in (*_STEPS, "exit")], none("high", "double"), none("low", "double"))
    return F.coalesce(F.aggregate("_day", start, stepped), start)


def double_momentum(bars: DataFrame, pairs: DataFrame, roc_col: str = "roc_3",
                    keys: tuple[str, ...] = KEYS, threshold: float = ROC_THRESHOLD, extra: tuple = ()) -> DataFrame:
    """One row per (symbol-day, pair, direction): row numbers of the four steps and the exit, their bars, and day facts.

    A day is gathered once, by the aggregate that also gives its facts, into an array of at most one
    element per bar time.  Parameters meet that one row and one pass over its array finds all steps; a
    day whose probability never reaches a threshold meets it without its bars.  The pass goes through a
    generator, below which no filter on its result is pushed: it runs once for each row, whatever is
    asked of the result.
    """
    bar = F.struct(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), exchange_time("ts").alias("clock"), F.col("ltp").cast("double").alias("ltp"),
        F.col("prob_long").alias("prob_long"), F.col("prob_short").alias("prob_short"), F.col(roc_col).cast("double").alias("roc"),
        F.col("delta_1m").cast("double").alias("delta"))
    days = day_metrics(bars, keys, (
        F.sort_array(F.collect_list(bar)).alias("_day"), F.max("prob_long").alias("max_prob_long"), F.max("prob_short").alias("max_prob_short"), *extra))
    days = days.withColumn("_day", F.transform("_day", lambda x, i: F.struct((i + 1).alias("rn"), x.alias("b"))))
    is_long = F.col("direction") == "LONG"
    best = F.when(is_long, F.col("max_prob_long")).otherwise(F.col("max_prob_short"))
    # pairs is a parameter table of a few dozen rows
    out = days.crossJoin(F.broadcast(pairs)).withColumn("_day", F.when(best >= F.col("theta"), F.col("_day")))
    walked = out.select("*", F.explode(F.array(_walk(F.col("theta"), is_long, threshold))).alias("_walk"))
    at = lambda name: F.get("_day", F.col(f"_walk.{name}") - 1)
    kept = [c for c in walked.columns if c not in ("_day", "_walk")]
    return walked.select(*kept, *[at(name).alias(f"_{name}") for name in (*_STEPS, "exit")], F.col("_walk.high").alias("held_high"),
                         F.col("_walk.low").alias("held_low"), *[F.col(f"_walk.{name}").alias(f"i_{name}") for name in _STEPS])


def sequence_trades(bars: DataFrame, pairs: DataFrame, roc_col: str = "roc_3",
                    keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The strategy table: one row per (pair, symbol, day, direction), 28 columns plus the pair."""
    order = F.unix_micros(F.col("ts").cast("timestamp"))
    earliest_best = lambda c, v: F.max_by(v, F.struct(F.col(c), -order))
    steps = double_momentum(bars, pairs, roc_col, keys, extra=(
        *[earliest_best(f"prob_{s}", exchange_time("ts")).alias(f"best_{s}_time") for s in ("long", "short")],
        *[earliest_best(f"prob_{s}", F.col("delta_1m") * F.col("close_price") / 100000.0).alias(f"best_{s}_value")
          for s in ("long", "short")],
    ))
    entry = F.col("_trigger.b")
    return _resolve(steps.withColumns({
        "theta_caught_time": F.col("_theta.b.clock"), "mark1_ts": F.col("_mark1.b.clock"), "between_ts": F.col("_between.b.clock"),
        "entry_time_ist": entry["clock"], "entry_price": entry["ltp"], "raw_exit": F.col("_exit.b.ltp"), "roc_at_entry": entry["roc"],
        "entry_prob": F.when(F.col("direction") == "LONG", entry["prob_long"]).otherwise(entry["prob_short"]), "entry_delta": entry["delta"]}))


def _resolve(t: DataFrame) -> DataFrame:
    """Stages, reasons, exits and excursions from the gathered values."""
    is_long = F.col("direction") == "LONG"
    sided = lambda a, b: F.when(is_long, a).otherwise(b)
    entry, raw_exit = F.col("entry_price"), F.col("raw_exit")
    traded = F.col("i_trigger").isNotNull()
    late = traded & (F.col("entry_time_ist") >= ENTRY_CUTOFF)
    open_trade = traded & ~late
    gain = lambda x: (x - entry) / entry
    mfe = sided(gain(F.col("held_high")), -gain(F.col("held_low")))
    mae = sided(gain(F.col("held_low")), -gain(F.col("held_high")))
    pnl = sided(gain(raw_exit), -gain(raw_exit))
    booked = mfe >= TAKE_PROFIT
    passed = sided(entry > F.col("open"), entry < F.col("open"))
    bypass = is_long & ~passed & (F.col("entry_prob") >= BYPASS_PROB)
    when_open = lambda c: F.when(open_trade, c)
    return t.select(
        "pair", slug("symbol", "trade_date").alias("slug"), "symbol", "trade_date", "direction",
        "max_prob_long", "max_prob_short",
        sided(F.col("best_long_time"), F.col("best_short_time")).alias("max_prob_time"),
        "theta_caught_time", "open", "close", "high", "low", "intraday_range_pct", "mark1_ts", "between_ts",
        F.when(F.col("i_theta").isNull(), "IDLE").when(F.col("i_mark1").isNull(), "ARMING")
        .when(F.col("i_between").isNull(), "MARK1").when(~traded, "BETWEEN").otherwise("TRIGGERED").alias("max_stage"),
        F.when(F.col("i_theta").isNull(), "NO_ALERT").when(F.col("i_mark1").isNull(), "MARK1_NEVER")
        .when(F.col("i_between").isNull(), "BETWEEN_NEVER").when(~traded, "MARK2_NEVER")
        .when(late, "CUTOFF_REJECTED_15:00").when(passed | bypass, "EXECUTED")
        .otherwise("DAILY_OPEN_FAILED").alias("rejection_reason"),
        "entry_time_ist", "entry_price",
        when_open(F.when(booked, entry * sided(F.lit(1.10), F.lit(0.90))).otherwise(raw_exit)).alias("exit_price"),
        when_open(F.when(booked, F.lit(TAKE_PROFIT)).otherwise(pnl)).alias("eod_pnl_pct"),
        when_open(mfe).alias("mfe_pct"), when_open(mae).alias("mae_pct"), "roc_at_entry",
        F.coalesce(when_open(passed | bypass), F.lit(False)).alias("daily_open_passed"),
        F.coalesce(when_open(bypass), F.lit(False)).alias("bypass_used"),
        (F.col("entry_delta") * entry / 100000.0).alias("delta_value_lakhs_at_theta"),
        sided(F.col("best_long_value"), F.col("best_short_value")).alias("delta_value_lakhs_at_max_prob"),
    )


def sweep_summary(trades: DataFrame) -> DataFrame:
    """Trade counts, win rate, returns and excursion shares of each pair."""
    done = F.col("rejection_reason") == "EXECUTED"
    pick = lambda c: F.when(done, c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return trades.groupBy("pair").agg(
        F.count_if(done).alias("total_trades"),
        zero(F.avg(pick((F.col("eod_pnl_pct") > 0).cast("double")))).alias("win_rate"),
        zero(F.avg(pick(F.col("eod_pnl_pct")))).alias("mean_return"),
        zero(F.sum(pick(F.col("eod_pnl_pct")))).alias("cumulative_return"),
        zero(F.avg(pick(F.col("mfe_pct")))).alias("mean_mfe"),
        zero(F.avg(pick(F.col("mae_pct")))).alias("mean_mae"),
        zero(F.avg(pick((F.col("mfe_pct") >= 0.03).cast("double")))).alias("mfe_ge_3pct"),
        zero(F.avg(pick((F.col("mfe_pct") >= 0.05).cast("double")))).alias("mfe_ge_5pct"),
        F.count_if(done & (F.col("direction") == "LONG")).alias("longs"),
        F.count_if(done & (F.col("direction") == "SHORT")).alias("shorts"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def rejection_breakdown(trades: DataFrame) -> DataFrame:
    return trades.groupBy("pair", "rejection_reason").agg(F.count(F.lit(1)).alias("n"))
