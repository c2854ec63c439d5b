"""Result statistics: trade metrics, deciles and tails, segments, slots, mover confusion, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import exchange_time
from tidemark.functions.scalars import clamp, pair_thresholds
from tidemark.operators.ranks import DEVIATION, MEAN, decile_of, exact_quantiles, global_rank, top_fraction
from tidemark.session import stage


def trade_metrics(trades: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    """Count, win rate, mean, median, profit factor and cumulative result per group, NULL groups too."""
    out = exact_quantiles(trades, pnl, [0.5], by, more={
        "_wins": "coalesce(sum(if(_x > 0, _x * n, NULL)), 0.0D)", "_losses": "coalesce(abs(sum(if(_x <= 0, _x * n, NULL))), 0.0D)",
        "_won": "sum(if(_x > 0, n, 0)) / sum(n)", "_mean": MEAN, "_sum": "sum(_x * n)"})
    wins, losses = F.col("_wins"), F.col("_losses")
    return out.select(
        *by, F.col("n").alias("num_trades"), F.round("_won", 4).alias("win_rate"), F.round("_mean", 6).alias("mean_pnl"),
        F.round(F.when(losses > 0, wins / losses).when(wins > 0, wins).otherwise(F.lit(1.0)), 4).alias("profit_factor"),
        F.round("_sum", 6).alias("cumulative_pnl"), F.round(F.col("q")[0], 6).alias("median_pnl"))


def threshold_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Trade results plus mean excursions and the share reaching 3 % and 5 %."""
    return trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl").alias("mean_return"), F.sum("pnl").alias("cumulative_return"),
        F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"),
        F.avg((F.col("mfe") >= 0.03).cast("double")).alias("mfe_ge_3pct"),
        F.avg((F.col("mfe") >= 0.05).cast("double")).alias("mfe_ge_5pct"),
    )


def fold_totals(trades: DataFrame, by: list[str], fold: str = "trade_date") -> DataFrame:
    """Totals per strategy and the mean win rate over folds that traded."""
    folds = trades.groupBy(*by, fold).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pnl") > 0).cast("double")).alias("win"),
        F.sum("pnl").alias("pnl"))
    return folds.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("total_trades"), F.sum("pnl").alias("cumulative_pnl"),
        F.avg("win").alias("mean_win_rate"), F.count(F.lit(1)).alias("active_folds"))


# --------------------------------------------------------------------------- deciles and tails

TAILS = [("Top 10%", 0.1, 0), ("Top 1%", 0.01, 0), ("Top 0.1%", 0.001, 0), ("Top 0.01%", 0.0001, 1)]


def _bucket_stats(rows: DataFrame, by: list[str], ret: str) -> DataFrame:
    out = exact_quantiles(rows, ret, [0.5, 0.05, 0.95], by, more={
        "mean_bps": MEAN, "std_bps": DEVIATION, "share_gt_100bps": "sum(if(_x > 100, n, 0)) / sum(n) * 100",
        "share_lt_minus_100bps": "sum(if(_x < -100, n, 0)) / sum(n) * 100"})
    return out.select(
        *by, F.col("n").alias("rows"), *[F.round(c, 2).alias(c) for c in ("mean_bps", "std_bps", "share_gt_100bps", "share_lt_minus_100bps")],
        F.round(F.col("q")[0], 2).alias("median_bps"), F.round(F.col("q")[1], 2).alias("p5_bps"),
        F.round(F.col("q")[2], 2).alias("p95_bps"))


def ranked_returns(bars: DataFrame, score: str, ret: str, direction: str = "LONG",
                   ties: tuple[str, ...] = ("symbol", "ts"), by: list[str] | None = None) -> DataFrame:
    """Rows with both values, the direction-signed return, and their rank by score (highest first)."""
    sign = 1.0 if direction == "LONG" else -1.0
    rows = bars.where(F.col(score).isNotNull() & F.col(ret).isNotNull()).withColumn("ret", F.col(ret) * sign)
    return global_rank(rows, score, list(ties), by, descending=True)


def decile_table(ranked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Statistics of each tenth; decile 1 holds the highest scores."""
    by = list(by or [])
    return _bucket_stats(ranked.withColumn("decile", decile_of("rn", "n")), [*by, "decile"], "ret")


def tail_buckets(ranked: DataFrame) -> DataFrame:
    """Statistics of the top 10, 1, 0.1 and 0.01 percent."""
    inside = [F.when(F.col("rn") <= F.greatest(F.lit(lo), F.floor(F.col("n") * F.lit(p))), F.lit(name))
              for name, p, lo in TAILS]
    # no row lies in the tails beyond the first cut: filter before the explode
    top = ranked.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(TAILS[0][1]))))
    rows = top.withColumn("bucket", F.explode(F.filter(F.array(*inside), lambda b: b.isNotNull())))
    return _bucket_stats(rows, ["bucket"], "ret")


# --------------------------------------------------------------------------- segments

def liquidity_segments(bars: DataFrame, top: int = 100, middle: int = 150, price: str = "ltp") -> DataFrame:
    """symbol, mean_price, segment by the rank of mean price (as the figures it reproduces do).

    The rank runs over the symbol dimension: one row per symbol.
    """
    means = bars.groupBy("symbol").agg(F.avg(price).alias("mean_price"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_price"), "symbol")
    rank = F.row_number().over(w)
    return means.withColumn("rank", rank.cast("bigint")).withColumn(
        "segment", F.when(F.col("rank") <= top, "TOP").when(F.col("rank") <= top + middle, "NEXT").otherwise("REST"))


def spread_segments(bars: DataFrame, spread: str = "spread") -> DataFrame:
    """symbol, mean_spread and TIGHT / WIDE by the median of the symbol means."""
    means = bars.groupBy("symbol").agg(F.avg(spread).alias("mean_spread"))
    median = exact_quantiles(means, "mean_spread", [0.5]).select(F.col("q")[0].alias("median_spread"))
    return means.crossJoin(F.broadcast(median)).withColumn(
        "segment", F.when(F.col("mean_spread") <= F.col("median_spread"), "TIGHT").otherwise("WIDE"))


# --------------------------------------------------------------------------- signal timing

def bucket_15m(long_signals: DataFrame, short_signals: DataFrame, width: int = 15) -> DataFrame:
    """Signals per quarter hour (UTC clock) and their share of each side."""
    def bucket():
        t = F.col("ts").cast("timestamp")
        start = F.minute(t) - F.minute(t) % width
        return F.concat(F.date_format(t, "HH"), F.lit(":"), F.lpad(start.cast("string"), 2, "0"))

    both = long_signals.select(bucket().alias("bucket"), F.lit(1).alias("is_long")).unionByName(
        short_signals.select(bucket().alias("bucket"), F.lit(0).alias("is_long")))
    counts = both.groupBy("bucket").agg(F.count_if(F.col("is_long") == 1).alias("long_n"),
                                        F.count_if(F.col("is_long") == 0).alias("short_n"))
    every = Window.partitionBy(F.lit(0))  # at most 96 buckets
    share = lambda c: F.col(c) * 100.0 / F.nullif(F.sum(c).over(every), F.lit(0))
    return counts.withColumns({"long_pct": share("long_n"), "short_pct": share("short_n")})


def opening_slots(signals: DataFrame, opens: str = "09:15:00", until: str = "09:30:00", full: int = 10) -> DataFrame:
    """Signals in the first quarter hour of each day: median per day and share of days at or over ``full``.

    Two readings are given: the opening window on the exchange clock, and the first half of any
    hour (minute < 30), which is the test the published figures were made with.
    """
    clock = exchange_time("ts")
    per_day = signals.groupBy("trade_date").agg(
        F.count_if((clock >= opens) & (clock < until)).alias("opening"),
        F.count_if(F.minute(F.col("ts").cast("timestamp")) < 30).alias("half_hour"),
        F.count(F.lit(1)).alias("total"))
    # one row per trading day
    return per_day.agg(
        F.count(F.lit(1)).alias("days"),
        F.percentile("opening", F.lit(0.5)).alias("median_opening"),
        (F.avg((F.col("opening") >= full).cast("double")) * 100).alias("pct_days_opening_full"),
        F.percentile("half_hour", F.lit(0.5)).alias("median_half_hour"),
        (F.avg((F.col("half_hour") >= full).cast("double")) * 100).alias("pct_days_half_hour_full"),
    )


def screener_baseline(bars: DataFrame, score: str = "prob_long", screen: str = "volume_burst",
                      ret: str = "ret_60m_bps", fraction: float = 0.001) -> DataFrame:
    """Mean forward return of the model's top rows and of as many top rows of a plain screener
    restricted to the first half of each hour."""
    known = bars.where(F.col(ret).isNotNull())
    model = top_fraction(known, score, fraction, ["symbol", "ts"], at_least=0)
    size = known.agg(F.floor(F.count(score) * F.lit(float(fraction))).alias("k"))
    early = known.where(F.minute(F.col("ts").cast("timestamp")) < 30)
    ranked = global_rank(early.where(F.col(screen).isNotNull()), screen, ["symbol", "ts"], descending=True)
    plain = ranked.crossJoin(F.broadcast(size)).where("rn <= k")
    mean = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows"), F.avg(ret).alias("mean_60m_bps")).select(
        F.lit(name).alias("source"), "rows", "mean_60m_bps")
    return mean(model, "model").unionByName(mean(plain, "screener"))


# --------------------------------------------------------------------------- mover confusion and scores

def mover_confusion(trades: DataFrame, threshold_pct: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """Symbol-days that moved against symbol-days with an executed trade.

    Two aggregates (symbol-day, then day) carry everything; totals are sums over days.
    """
    by = list(by or [])
    done = F.col("rejection_reason") == "EXECUTED"
    t = F.lit(float(threshold_pct))
    base = trades.groupBy(*by, "trade_date", "symbol").agg(
        F.first("open").alias("open"), F.first("high").alias("high"), F.first("low").alias("low"),
        F.first("intraday_range_pct").alias("range"),
        F.max(done).alias("predicted"), F.max(done & (F.col("direction") == "LONG")).alias("p_long"),
        F.max(done & (F.col("direction") == "SHORT")).alias("p_short"))
    safe = F.nullif(F.col("open"), F.lit(0.0))
    no = lambda c: F.coalesce(c, F.lit(False))
    base = base.withColumns({
        "up": no((F.col("high") - safe) / safe * 100.0 >= t),
        "down": no((F.col("low") - safe) / safe * 100.0 <= -t),
    }).withColumn("moved", F.col("up") | F.col("down") | no(F.col("range") >= t))
    p, m = F.col("predicted"), F.col("moved")
    days = base.groupBy(*by, "trade_date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m).alias("movers"), F.count_if(p).alias("pred"),
        F.count_if(p & m).alias("tp"), F.count_if(F.col("p_long") & F.col("up")).alias("l_hit"),
        F.count_if(F.col("p_long")).alias("l_n"), F.count_if(F.col("p_short") & F.col("down")).alias("s_hit"),
        F.count_if(F.col("p_short")).alias("s_n"))
    rate = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    s = lambda c: F.sum(c).cast("bigint")
    total = days.groupBy(*by).agg(
        s("n").alias("universe_symbol_days"), s("movers").alias("actual_movers"), s("pred").alias("predicted_movers"),
        s("tp").alias("true_positive_movers"),
        F.avg(rate(F.col("tp"), F.col("pred"))).alias("mean_daily_mover_precision"),
        F.avg(rate(F.col("tp"), F.col("movers"))).alias("mean_daily_mover_recall"),
        rate(s("l_hit"), s("l_n")).alias("long_directional_precision"),
        rate(s("s_hit"), s("s_n")).alias("short_directional_precision"))
    n, mv, pr, tp = (F.col(c) for c in ("universe_symbol_days", "actual_movers", "predicted_movers", "true_positive_movers"))
    total = total.withColumns({
        "actual_non_movers": n - mv, "false_positive_non_movers": pr - tp, "missed_movers": mv - tp,
        "true_negative_non_movers": n - mv - (pr - tp),
        "mover_precision": rate(tp, pr), "mover_recall": rate(tp, mv),
    })
    tn, fp, neg = F.col("true_negative_non_movers"), F.col("false_positive_non_movers"), F.col("actual_non_movers")
    pc, rc = F.col("mover_precision"), F.col("mover_recall")
    return total.withColumns({
        "non_mover_specificity": rate(tn, neg), "false_positive_rate": rate(fp, neg),
        "classification_accuracy": rate(tp + tn, n), "mover_f1": rate(2 * pc * rc, pc + rc),
    })


# Configuration score.
SCORE_WEIGHTS = {
    "mover_recall": 0.24, "mover_precision": 0.18, "non_mover_specificity": 0.12, "mover_hit_rate": 0.08,
    "win_rate": 0.08, "directional_precision": 0.05, "cum_return_component": 0.20, "mean_mfe_component": 0.05,
}


def config_metrics(trades: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """Trade results and mover confusion of each pair, with the thresholds read from its label."""
    trades = stage(trades)  # read by three branches
    done = trades.where("rejection_reason = 'EXECUTED'").withColumns({
        "eod_pnl_pct": F.coalesce("eod_pnl_pct", F.lit(0.0)), "mfe_pct": F.coalesce("mfe_pct", F.lit(0.0))})
    ran = done.groupBy("pair").agg(
        F.count(F.lit(1)).alias("executed_trades"), F.countDistinct("trade_date").alias("unique_days"),
        F.avg((F.col("eod_pnl_pct") > 0).cast("double")).alias("win_rate"),
        F.avg((F.col("mfe_pct") >= threshold_pct / 100.0).cast("double")).alias("mover_hit_rate"),
        F.sum("eod_pnl_pct").alias("cumulative_return"), F.avg("mfe_pct").alias("mean_mfe"))
    all_days = trades.groupBy("pair").agg(F.countDistinct("trade_date").alias("all_days"))
    out = mover_confusion(trades, threshold_pct, ["pair"]).join(all_days, "pair").join(ran, "pair", "left")
    zero = ("win_rate", "mover_hit_rate", "cumulative_return", "mean_mfe")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero})
    out = out.withColumn("unique_days", F.coalesce("unique_days", "all_days")).drop("all_days")
    out = out.withColumn("executed_trades", F.coalesce("executed_trades", F.lit(0).cast("bigint")))
    long_th, short_th = pair_thresholds("pair")
    return out.withColumns({
        "trades_per_day": F.col("executed_trades") / F.col("unique_days"), "long_th": long_th, "short_th": short_th})


def config_score(metrics: DataFrame, min_per_day: float, max_per_day: float, weights: dict[str, float] | None = None,
                 fpr_multiplier: float = 0.30, penalty_cap: float = 0.20) -> DataFrame:
    """Weighted score less penalties for false positives and for too few or too many trades; ranked."""
    weights = weights or SCORE_WEIGHTS
    parts = {
        "directional_precision": (F.col("long_directional_precision") + F.col("short_directional_precision")) / 2.0,
        "cum_return_component": clamp((F.col("cumulative_return") + 1.0) / 2.0, 0.0, 1.0),
        "mean_mfe_component": clamp(F.col("mean_mfe") / 0.10, 0.0, 1.0),
    }
    base = sum(((parts[k] if k in parts else F.col(k)) * F.lit(w) for k, w in weights.items()), F.lit(0.0))
    tpd, cap = F.col("trades_per_day"), F.lit(penalty_cap)
    rate_penalty = (
        F.when(tpd == 0, cap).when(tpd < min_per_day, F.least((min_per_day - tpd) * 0.01, cap))
        .when(tpd > max_per_day, F.least((tpd - max_per_day) * 0.01, cap)).otherwise(F.lit(0.0)))
    false_penalty = F.least(F.col("false_positive_rate") * fpr_multiplier, cap)
    # one row per configuration; scores equal to nine places share their order by label
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("score", 9).desc(), "pair"))
    return metrics.withColumn("score", F.greatest(base - false_penalty - rate_penalty, F.lit(0.0))).withColumn(
        "rank", rank.cast("bigint"))
