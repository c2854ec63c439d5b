"""Queries over scored bars: momentum, sequences, alerts, holds, rules, event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.bars_features import SQL_LABELS, labelled_bars
from tidemark.catalog.inputs import (
    Registry, SQL_BARS, naive_ts, rd, rounded, scored_bars, sql_clock,
)
from tidemark.operators import alerts as A
from tidemark.operators import holds as H
from tidemark.operators import momentum as M
from tidemark.operators import rules as R
from tidemark.operators import sequences as Q
from tidemark.operators import stats as S
from tidemark.operators import study as E
from tidemark.operators.labels import label_name
from tidemark.operators.ranks import best_row

query = Registry()
QUERIES, SQL = query.queries, query.sql

_D = "PARTITION BY symbol, trade_date ORDER BY ts"
_HEAD = ["symbol", "trade_date", "ts"]


# --------------------------------------------------------------------------- momentum

@query("roc_variants", f"""WITH {SQL_BARS}
SELECT symbol, trade_date, ts, rd(roc_3, 6) AS roc_day_3,
  rd((ltp - lag(ltp, 9) OVER d) / lag(ltp, 9) OVER d * 100.0, 6) AS roc_day_9,
  rd((close_price - lag(close_price, 9) OVER s) / lag(close_price, 9) OVER s * 100.0, 6) AS roc_symbol_9,
  rd((close_price - lag(close_price, 3) OVER s) / lag(close_price, 3) OVER s * 100.0, 6) AS roc_symbol_3,
  rd(coalesce((ltp - lag(ltp, 2) OVER d) / lag(ltp, 2) OVER d * 100.0, 0.0), 6) AS roc_day_2
FROM bars WINDOW d AS ({_D}), s AS (PARTITION BY symbol ORDER BY ts)""")
def roc_variants(spark, sf):
    b = scored_bars(spark, sf)
    return naive_ts(b.select(
        *_HEAD, rd(M.roc(3), 6).alias("roc_day_3"), rd(M.roc(9, "ltp", fill=None), 6).alias("roc_day_9"),
        rd(M.roc(9, keys=("symbol",), fill=None), 6).alias("roc_symbol_9"),
        rd(M.roc(3, keys=("symbol",), fill=None), 6).alias("roc_symbol_3"), rd(M.roc(2, "ltp"), 6).alias("roc_day_2")))


SQL_CROSS = f"""c0 AS (SELECT *, (close_price - lag(close_price, 3) OVER w) / lag(close_price, 3) OVER w * 100.0 AS r FROM bars WINDOW w AS ({_D})),
c1 AS (SELECT *, coalesce(r >= 1.0 AND lag(r) OVER w < 1.0, FALSE) AS long_cross, coalesce(r <= -1.0 AND lag(r) OVER w > -1.0, FALSE) AS short_cross,
  lead(open_price) OVER w AS entry_price, lead(ts) OVER w AS entry_ts, last_value(close_price) OVER wa AS exit_eod,
  coalesce(lead(close_price, 30) OVER w, last_value(close_price) OVER wa) AS exit_30m,
  coalesce(lead(close_price, 60) OVER w, last_value(close_price) OVER wa) AS exit_60m
  FROM c0 WINDOW w AS ({_D}), wa AS ({_D} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
cr AS (SELECT *, CAST(sum(CAST(long_cross AS INT)) OVER w AS BIGINT) AS long_cross_n, CAST(sum(CAST(short_cross AS INT)) OVER w AS BIGINT) AS short_cross_n
  FROM c1 WINDOW w AS ({_D}))"""


@query("cross_events", f"""WITH {SQL_BARS}, {SQL_CROSS}
SELECT symbol, trade_date, ts, long_cross, short_cross, long_cross_n, short_cross_n,
  long_cross AND long_cross_n >= 2 AS long_double_cross, short_cross AND short_cross_n >= 2 AS short_double_cross
FROM cr WHERE long_cross OR short_cross""")
def cross_events(spark, sf):
    b = scored_bars(spark, sf).withColumn("roc_3", M.roc(3, fill=None))
    return naive_ts(M.crosses(b).where("long_cross OR short_cross").select(
        *_HEAD, *[f"{s}_{k}" for s in ("long", "short") for k in ("cross", "cross_n", "double_cross")]))


def _sql_events(groups=False):
    g = ", grp" if groups else ""
    sides = [("single_long", "long_cross", "LONG", "top_long"), ("single_short", "short_cross", "SHORT", "top_short")]
    if not groups:
        sides += [("double_long", "long_cross AND long_cross_n >= 2", "LONG", ""),
                  ("double_short", "short_cross AND short_cross_n >= 2", "SHORT", "")]
    parts = " UNION ALL ".join(
        f"SELECT *, '{n}' AS pattern, '{d}' AS direction{f', CASE WHEN {t} THEN chr(65) ELSE chr(66) END AS grp' if groups else ''} "
        f"FROM cr WHERE {c}" for n, c, d, t in sides)
    clock = sql_clock("entry_ts")
    nets = ", ".join(f"g_{h} AS gross_{h}, g_{h} - cost_bps AS net_{h}" for h in ("30m", "60m", "eod"))
    return f"""ev AS (SELECT *, row_number() OVER (PARTITION BY pattern{g}, symbol, trade_date ORDER BY ts) AS k FROM ({parts})),
tr AS (SELECT pattern, direction{g}, symbol, trade_date, ts, entry_ts, entry_price, cost_bps, {nets} FROM (
  SELECT *, CASE WHEN {clock} < '10:00:00' AND {clock} >= '05:30:00' THEN 30.0 ELSE 15.0 END AS cost_bps,
    {', '.join(f"(exit_{h} - entry_price) / entry_price * 10000.0 * CASE WHEN direction = 'LONG' THEN 1.0 ELSE -1.0 END AS g_{h}" for h in ('30m', '60m', 'eod'))}
  FROM ev WHERE k = 1 AND entry_price > 0)),
lg AS ({' UNION ALL '.join(f"SELECT pattern{g}, trade_date, '{h}' AS horizon, gross_{h} AS gross, net_{h} AS net FROM tr" for h in ('30m', '60m', 'eod'))})"""


@query("time_cost", f"""WITH {SQL_BARS}, {SQL_CROSS}, {_sql_events()}
SELECT pattern, direction, symbol, trade_date, ts, entry_ts, entry_price, CAST(cost_bps AS DOUBLE) AS cost_bps,
  {', '.join(f'rd({k}_{h}, 4) AS {k}_{h}' for h in ('30m', '60m', 'eod') for k in ('gross', 'net'))} FROM tr""")
def time_cost(spark, sf):
    t = E.event_trades(E.study_bars(scored_bars(spark, sf)))
    return naive_ts(rounded(t, *[f"{k}_{h}" for h in ("30m", "60m", "eod") for k in ("gross", "net")], places=4), "ts", "entry_ts")


@query("event_study", f"""WITH {SQL_BARS}, {SQL_CROSS}, {_sql_events()},
 dy AS (SELECT pattern, horizon, trade_date, avg(net) AS m FROM lg GROUP BY ALL),
 a AS (SELECT pattern, horizon, count(*) AS trades, avg(gross) AS mean_gross, avg(net) AS mean_net, quantile_cont(net, 0.5) AS median_net,
   stddev_samp(net) AS std_net, avg(CASE WHEN net > 0 THEN 100.0 ELSE 0.0 END) AS pct_positive FROM lg GROUP BY ALL),
 b AS (SELECT pattern, horizon, count(*) AS days, avg(m) AS day_mean, stddev_samp(m) AS day_std,
   CASE WHEN stddev_samp(m) > 0 THEN avg(m) / (stddev_samp(m) / sqrt(count(*))) END AS day_t, count(*) FILTER (WHERE m > 0) AS positive_days FROM dy GROUP BY ALL)
SELECT pattern, horizon, trades, rd(mean_gross, 4) AS mean_gross, rd(mean_net, 4) AS mean_net, rd(median_net, 4) AS median_net,
  rd(std_net, 4) AS std_net, rd(pct_positive, 4) AS pct_positive, days, rd(day_mean, 4) AS day_mean, rd(day_std, 4) AS day_std,
  rd(day_t, 4) AS day_t, positive_days FROM a JOIN b USING (pattern, horizon)""")
def event_study(spark, sf):
    out = E.event_study(E.event_trades(E.study_bars(scored_bars(spark, sf))))
    return rounded(out, "mean_gross", "mean_net", "median_net", "std_net", "pct_positive", "day_mean", "day_std", "day_t", places=4)


_SQL_TOP = """lim AS (SELECT trade_date, quantile_cont(prob_long, 0.9) AS ql, quantile_cont(prob_short, 0.9) AS qs FROM bars0 GROUP BY 1),
bars AS (SELECT b.*, prob_long >= ql AS top_long, prob_short >= qs AS top_short FROM bars0 b JOIN lim USING (trade_date))"""
_SQL_OVERLAY = f"""WITH {SQL_BARS.replace('bars AS (', 'bars0 AS (')}, {_SQL_TOP}, {SQL_CROSS}, {_sql_events(True)}"""

SQL_CLUSTER = """{name} AS (
  SELECT {by}, CAST(sum(na) AS BIGINT) AS n_a, CAST(sum(nb) AS BIGINT) AS n_b, rd(sum(sa) / nullif(sum(na), 0), 4) AS mean_a,
    rd(sum(sb) / nullif(sum(nb), 0), 4) AS mean_b, rd(sum(sa) / nullif(sum(na), 0) - sum(sb) / nullif(sum(nb), 0), 4) AS pooled_diff,
    count(diff) AS days, rd(CASE WHEN count(diff) > 1 THEN avg(diff) END, 4) AS day_diff,
    rd(CASE WHEN count(diff) > 1 AND stddev_samp(diff) > 0 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(diff))) END, 4) AS t_stat,
    count(*) FILTER (WHERE diff > 0) AS positive_days
  FROM (SELECT *, sa / nullif(na, 0) - sb / nullif(nb, 0) AS diff FROM (
    SELECT {by}, trade_date, sum(value) FILTER (WHERE grp = 'A') AS sa, count(value) FILTER (WHERE grp = 'A') AS na,
      sum(value) FILTER (WHERE grp = 'B') AS sb, count(value) FILTER (WHERE grp = 'B') AS nb FROM {src} GROUP BY ALL)) GROUP BY ALL)"""
CLUSTER_ROUNDED = ("mean_a", "mean_b", "pooled_diff", "day_diff", "t_stat")


@query("overlay_ab", f"""{_SQL_OVERLAY}, v AS (SELECT pattern, horizon, grp, trade_date, net AS value FROM lg),
{SQL_CLUSTER.format(name='res', by='pattern, horizon', src='v')} SELECT * FROM res""")
def overlay_ab(spark, sf):
    _, table = E.overlay_ab(scored_bars(spark, sf), q=0.9)
    return rounded(table, *CLUSTER_ROUNDED, places=4)


@query("daily_counts", f"""{_SQL_OVERLAY}, n AS (SELECT pattern, grp, trade_date, count(*) AS n FROM tr GROUP BY ALL)
SELECT pattern, grp, CAST(sum(n) AS BIGINT) AS events, count(*) AS days, min(n) AS min_day, quantile_cont(n, 0.5) AS median_day, max(n) AS max_day FROM n GROUP BY ALL""")
def daily_counts(spark, sf):
    trades, _ = E.overlay_ab(scored_bars(spark, sf), q=0.9)
    return E.daily_counts(trades, ["pattern", "grp"])


@query("systematic_sample", f"""WITH {SQL_BARS} SELECT symbol, trade_date, ts, close_price FROM (
  SELECT *, row_number() OVER ({_D}) AS k FROM bars) WHERE (k - 1) % 5 = 0""")
def systematic_sample(spark, sf):
    return naive_ts(M.systematic_sample(scored_bars(spark, sf), 5).select(*_HEAD, "close_price"))


@query("running_vwap", f"""WITH {SQL_BARS}
SELECT symbol, trade_date, ts, first_value(ltp) OVER w AS daily_open,
  rd(CASE WHEN sum(volume_1m) OVER w > 0 THEN sum(vwap_1m * volume_1m) OVER w / sum(volume_1m) OVER w ELSE first_value(ltp) OVER w END, 5) AS running_vwap
FROM bars WINDOW w AS ({_D} ROWS UNBOUNDED PRECEDING)""")
def running_vwap(spark, sf):
    return naive_ts(rounded(scored_bars(spark, sf).withColumns(M.running_vwap()).select(*_HEAD, "daily_open", "running_vwap"),
                            "running_vwap", places=5))


# --------------------------------------------------------------------------- sequences

_PAIRS = Q.THRESHOLD_PAIRS
SQL_SEQ = f"""pairs AS (SELECT pair, direction, CAST(CASE WHEN direction = 'LONG' THEN regexp_extract(pair, 'L(\\d+)_S(\\d+)', 1)
    ELSE regexp_extract(pair, 'L(\\d+)_S(\\d+)', 2) END AS INT) / CAST(100 AS DOUBLE) AS theta
  FROM (SELECT unnest([{', '.join(repr(p) for p in _PAIRS)}]) AS pair) CROSS JOIN (SELECT unnest(['LONG', 'SHORT']) AS direction)),
sp AS (SELECT b.*, pair, direction, theta, row_number() OVER (PARTITION BY pair, direction, symbol, trade_date ORDER BY ts) AS rn,
  {sql_clock()} AS clock, CASE WHEN direction = 'LONG' THEN prob_long ELSE prob_short END AS prob,
  CASE WHEN direction = 'LONG' THEN roc_3 ELSE -roc_3 END AS move FROM bars b CROSS JOIN pairs),
s0 AS (SELECT *, min(CASE WHEN prob >= theta THEN rn END) OVER p AS i0 FROM sp WINDOW p AS (PARTITION BY pair, direction, symbol, trade_date)),
s1 AS (SELECT *, min(CASE WHEN rn > i0 AND move >= 1 THEN rn END) OVER p AS i1 FROM s0 WINDOW p AS (PARTITION BY pair, direction, symbol, trade_date)),
s2 AS (SELECT *, min(CASE WHEN rn > i1 AND move < 1 THEN rn END) OVER p AS i2 FROM s1 WINDOW p AS (PARTITION BY pair, direction, symbol, trade_date)),
s3 AS (SELECT *, min(CASE WHEN rn > i2 AND move >= 1 THEN rn END) OVER p AS i3 FROM s2 WINDOW p AS (PARTITION BY pair, direction, symbol, trade_date)),
s4 AS (SELECT *, coalesce(min(CASE WHEN rn >= i3 AND clock >= '15:00:00' THEN rn END) OVER p, max(rn) OVER p) AS ix FROM s3
  WINDOW p AS (PARTITION BY pair, direction, symbol, trade_date)),
sg AS (SELECT pair, direction, symbol, trade_date, max(i0) AS i0, max(i1) AS i1, max(i2) AS i2, max(i3) AS i3,
  max(prob_long) AS max_prob_long, max(prob_short) AS max_prob_short, arg_max(clock, (prob, -rn)) AS max_prob_time,
  arg_max(delta_1m * close_price / 100000.0, (prob, -rn)) AS dv_max,
  arg_min(open_price, rn) AS open, arg_max(ltp, rn) AS close, max(ltp) AS high, min(ltp) AS low,
  max(CASE WHEN rn = i0 THEN clock END) AS theta_caught_time, max(CASE WHEN rn = i1 THEN clock END) AS mark1_ts,
  max(CASE WHEN rn = i2 THEN clock END) AS between_ts, max(CASE WHEN rn = i3 THEN clock END) AS entry_time_ist,
  max(CASE WHEN rn = i3 THEN ltp END) AS entry_price, max(CASE WHEN rn = ix THEN ltp END) AS raw_exit, max(CASE WHEN rn = i3 THEN roc_3 END) AS roc_at_entry,
  max(CASE WHEN rn = i3 THEN prob END) AS ep, max(CASE WHEN rn = i3 THEN delta_1m END) AS ed,
  max(CASE WHEN rn BETWEEN i3 AND ix THEN ltp END) AS hh, min(CASE WHEN rn BETWEEN i3 AND ix THEN ltp END) AS ll FROM s4 GROUP BY ALL),
sh AS (SELECT *, i3 IS NOT NULL AND entry_time_ist >= '15:00:00' AS late, i3 IS NOT NULL AND entry_time_ist < '15:00:00' AS opened,
  CASE WHEN direction = 'LONG' THEN (hh - entry_price) / entry_price ELSE -((ll - entry_price) / entry_price) END AS mfe,
  CASE WHEN direction = 'LONG' THEN (ll - entry_price) / entry_price ELSE -((hh - entry_price) / entry_price) END AS mae,
  CASE WHEN direction = 'LONG' THEN (raw_exit - entry_price) / entry_price ELSE -((raw_exit - entry_price) / entry_price) END AS pnl,
  CASE WHEN direction = 'LONG' THEN entry_price > open ELSE entry_price < open END AS passed FROM sg),
strategy AS (SELECT pair, upper(symbol) || '_' || strftime(trade_date, '%d_%b_%y') AS slug, symbol, trade_date, direction, max_prob_long, max_prob_short,
  max_prob_time, theta_caught_time, open, close, high, low, (high - low) / low * 100 AS intraday_range_pct, mark1_ts, between_ts,
  CASE WHEN i0 IS NULL THEN 'IDLE' WHEN i1 IS NULL THEN 'ARMING' WHEN i2 IS NULL THEN 'MARK1' WHEN i3 IS NULL THEN 'BETWEEN' ELSE 'TRIGGERED' END AS max_stage,
  CASE WHEN i0 IS NULL THEN 'NO_ALERT' WHEN i1 IS NULL THEN 'MARK1_NEVER' WHEN i2 IS NULL THEN 'BETWEEN_NEVER' WHEN i3 IS NULL THEN 'MARK2_NEVER'
    WHEN late THEN 'CUTOFF_REJECTED_15:00' WHEN passed OR (direction = 'LONG' AND ep >= 0.35) THEN 'EXECUTED' ELSE 'DAILY_OPEN_FAILED' END AS rejection_reason,
  entry_time_ist, entry_price,
  CASE WHEN opened THEN CASE WHEN mfe >= 0.10 THEN entry_price * CASE WHEN direction = 'LONG' THEN 1.10 ELSE 0.90 END ELSE raw_exit END END AS exit_price,
  CASE WHEN opened THEN CASE WHEN mfe >= 0.10 THEN 0.10 ELSE pnl END END AS eod_pnl_pct, CASE WHEN opened THEN mfe END AS mfe_pct, CASE WHEN opened THEN mae END AS mae_pct,
  roc_at_entry, opened AND (passed OR (direction = 'LONG' AND ep >= 0.35)) AS daily_open_passed,
  opened AND NOT passed AND direction = 'LONG' AND ep >= 0.35 AS bypass_used,
  ed * entry_price / 100000.0 AS delta_value_lakhs_at_theta, dv_max AS delta_value_lakhs_at_max_prob FROM sh)"""
_STRAT_ROUNDED = ["intraday_range_pct", "exit_price", "eod_pnl_pct", "mfe_pct", "mae_pct", "roc_at_entry",
                  "delta_value_lakhs_at_theta", "delta_value_lakhs_at_max_prob"]


def strategy(spark, sf):
    return Q.sequence_trades(scored_bars(spark, sf), Q.pair_table(spark))


@query("double_momentum", f"""WITH {SQL_BARS}, {SQL_SEQ}
SELECT pair, direction, symbol, trade_date, max(i0) AS i_theta, max(i1) AS i_mark1, max(i2) AS i_between, max(i3) AS i_trigger FROM s3 GROUP BY ALL""")
def double_momentum(spark, sf):
    steps = Q.double_momentum(scored_bars(spark, sf), Q.pair_table(spark))
    return steps.select("pair", "direction", "symbol", "trade_date",
                        *[F.col(c).cast("bigint").alias(c) for c in ("i_theta", "i_mark1", "i_between", "i_trigger")])


@query("double_momentum_exits", f"""WITH {SQL_BARS}, {SQL_SEQ}
SELECT {', '.join(f'rd({c}, 6) AS {c}' if c in _STRAT_ROUNDED else c for c in Q.STRATEGY_COLUMNS)} FROM strategy""")
def double_momentum_exits(spark, sf):
    return rounded(strategy(spark, sf), *_STRAT_ROUNDED)


_SUM = ["win_rate", "mean_return", "cumulative_return", "mean_mfe", "mean_mae", "mfe_ge_3pct", "mfe_ge_5pct"]


@query("sweep_summary", f"""WITH {SQL_BARS}, {SQL_SEQ}, x AS (SELECT *, rejection_reason = 'EXECUTED' AS done FROM strategy)
SELECT pair, count(*) FILTER (WHERE done) AS total_trades,
  {', '.join(f'rd(coalesce({e} FILTER (WHERE done), 0.0), 6) AS {n}' for n, e in zip(_SUM, ['avg(CAST(eod_pnl_pct > 0 AS INT))', 'avg(eod_pnl_pct)', 'sum(eod_pnl_pct)', 'avg(mfe_pct)', 'avg(mae_pct)', 'avg(CAST(mfe_pct >= 0.03 AS INT))', 'avg(CAST(mfe_pct >= 0.05 AS INT))']))},
  count(*) FILTER (WHERE done AND direction = 'LONG') AS longs, count(*) FILTER (WHERE done AND direction = 'SHORT') AS shorts, count(*) AS total_rows
FROM x GROUP BY 1""")
def sweep_summary(spark, sf):
    return rounded(Q.sweep_summary(strategy(spark, sf)), *_SUM)


@query("rejection_breakdown", f"WITH {SQL_BARS}, {SQL_SEQ} SELECT pair, rejection_reason, count(*) AS n FROM strategy GROUP BY ALL")
def rejection_breakdown(spark, sf):
    return Q.rejection_breakdown(strategy(spark, sf))


# --------------------------------------------------------------------------- movers and configuration scores

_MOVE_PCT = 3.0
_COUNTS = ["universe_symbol_days", "actual_movers", "actual_non_movers", "predicted_movers", "true_positive_movers",
           "false_positive_non_movers", "missed_movers", "true_negative_non_movers"]
_RATES = ["mover_precision", "mover_recall", "non_mover_specificity", "false_positive_rate", "classification_accuracy", "mover_f1",
          "mean_daily_mover_precision", "mean_daily_mover_recall", "long_directional_precision", "short_directional_precision"]
_rate = lambda a, b: f"CASE WHEN {b} <> 0 THEN ({a}) / ({b}) ELSE 0.0 END"
SQL_MOVERS = f"""mb AS (SELECT pair, trade_date, symbol, any_value(open) AS o, any_value(high) AS h, any_value(low) AS l, any_value(intraday_range_pct) AS r,
  bool_or(rejection_reason = 'EXECUTED') AS p, bool_or(rejection_reason = 'EXECUTED' AND direction = 'LONG') AS pl,
  bool_or(rejection_reason = 'EXECUTED' AND direction = 'SHORT') AS ps FROM strategy GROUP BY ALL),
mc AS (SELECT *, (h - o) / o * 100.0 >= {_MOVE_PCT} AS up, (l - o) / o * 100.0 <= -{_MOVE_PCT} AS dn FROM mb),
md AS (SELECT *, up OR dn OR r >= {_MOVE_PCT} AS m FROM mc),
dd AS (SELECT pair, trade_date, count(*) FILTER (WHERE m) AS a, count(*) FILTER (WHERE p) AS q, count(*) FILTER (WHERE p AND m) AS tp FROM md GROUP BY ALL),
da AS (SELECT pair, avg({_rate('tp', 'q')}) AS dp, avg({_rate('tp', 'a')}) AS dr FROM dd GROUP BY 1),
mt AS (SELECT pair, count(*) AS n, count(*) FILTER (WHERE m) AS a, count(*) FILTER (WHERE p) AS q, count(*) FILTER (WHERE p AND m) AS tp,
  {_rate('count(*) FILTER (WHERE pl AND up)', 'count(*) FILTER (WHERE pl)')} AS lp, {_rate('count(*) FILTER (WHERE ps AND dn)', 'count(*) FILTER (WHERE ps)')} AS sp FROM md GROUP BY 1),
movers AS (SELECT pair, n AS universe_symbol_days, a AS actual_movers, n - a AS actual_non_movers, q AS predicted_movers, tp AS true_positive_movers,
  q - tp AS false_positive_non_movers, a - tp AS missed_movers, n - a - (q - tp) AS true_negative_non_movers,
  {_rate('tp', 'q')} AS mover_precision, {_rate('tp', 'a')} AS mover_recall, {_rate('n - a - (q - tp)', 'n - a')} AS non_mover_specificity,
  {_rate('q - tp', 'n - a')} AS false_positive_rate, {_rate('tp + n - a - (q - tp)', 'n')} AS classification_accuracy,
  {_rate(f"2 * ({_rate('tp', 'q')}) * ({_rate('tp', 'a')})", f"({_rate('tp', 'q')}) + ({_rate('tp', 'a')})")} AS mover_f1,
  dp AS mean_daily_mover_precision, dr AS mean_daily_mover_recall, lp AS long_directional_precision, sp AS short_directional_precision
  FROM mt JOIN da USING (pair))"""


@query("mover_confusion", f"WITH {SQL_BARS}, {SQL_SEQ}, {SQL_MOVERS} SELECT pair, {', '.join(_COUNTS)}, {', '.join(f'rd({c}, 6) AS {c}' for c in _RATES)} FROM movers")
def mover_confusion(spark, sf):
    return rounded(S.mover_confusion(strategy(spark, sf), _MOVE_PCT, ["pair"]), *_RATES)


_W = S.SCORE_WEIGHTS


@query("config_score", f"""WITH {SQL_BARS}, {SQL_SEQ}, {SQL_MOVERS},
 ex AS (SELECT pair, count(*) AS executed_trades, count(DISTINCT trade_date) AS days, avg(CAST(eod_pnl_pct > 0 AS INT)) AS win_rate,
   avg(CAST(mfe_pct >= {_MOVE_PCT / 100} AS INT)) AS mover_hit_rate, sum(eod_pnl_pct) AS cumulative_return, avg(mfe_pct) AS mean_mfe
   FROM strategy WHERE rejection_reason = 'EXECUTED' GROUP BY 1),
 sc AS (SELECT pair, executed_trades, executed_trades / days AS trades_per_day, greatest(
   {_W['mover_recall']} * mover_recall + {_W['mover_precision']} * mover_precision + {_W['non_mover_specificity']} * non_mover_specificity
   + {_W['mover_hit_rate']} * mover_hit_rate + {_W['win_rate']} * win_rate
   + {_W['directional_precision']} * (long_directional_precision + short_directional_precision) / 2.0
   + {_W['cum_return_component']} * greatest(0.0, least(1.0, (cumulative_return + 1.0) / 2.0))
   + {_W['mean_mfe_component']} * greatest(0.0, least(1.0, mean_mfe / 0.10))
   - least(false_positive_rate * 0.30, 0.20)
   - CASE WHEN executed_trades / days = 0 THEN 0.20 WHEN executed_trades / days < 2.0 THEN least((2.0 - executed_trades / days) * 0.01, 0.20)
     WHEN executed_trades / days > 4.0 THEN least((executed_trades / days - 4.0) * 0.01, 0.20) ELSE 0.0 END, 0.0) AS score
   FROM movers JOIN ex USING (pair))
SELECT pair, executed_trades, rd(trades_per_day, 6) AS trades_per_day, rd(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, pair) AS rank FROM sc""")
def config_score(spark, sf):
    out = S.config_score(S.config_metrics(strategy(spark, sf), _MOVE_PCT), 2.0, 4.0)
    return rounded(out.select("pair", "executed_trades", "trades_per_day", "score", "rank"), "trades_per_day", "score")


@query("export_variations", f"""WITH {SQL_BARS}, {SQL_SEQ}
SELECT CASE pair WHEN 'L20_S20' THEN 'Standard_0.20' ELSE 'Standard_0.25' END AS variation, symbol, trade_date, direction, entry_time_ist
FROM strategy WHERE pair IN ('L20_S20', 'L25_S25') AND rejection_reason = 'EXECUTED'""")
def export_variations(spark, sf):
    names = F.create_map(*[F.lit(x) for x in ("L20_S20", "Standard_0.20", "L25_S25", "Standard_0.25")])
    done = strategy(spark, sf).where("rejection_reason = 'EXECUTED'").withColumn("variation", F.try_element_at(names, "pair"))
    return done.where("variation IS NOT NULL").select("variation", "symbol", "trade_date", "direction", "entry_time_ist")


# --------------------------------------------------------------------------- alerts

_THETA = 0.85
_EXPIRY = 6
_PRED = "CASE WHEN prob_long >= {t} AND prob_long > prob_short THEN 'LONG' WHEN prob_short >= {t} AND prob_short > prob_long THEN 'SHORT' ELSE 'NO_TRADE' END"


def predicted(spark, sf):
    return scored_bars(spark, sf).withColumn("pred", A.classify(_THETA))


def _sql_alerts(trend, roc="roc_9", src="bars", extra=""):
    """Sequential rule restated as groups of bars since the latest alert."""
    part = f"symbol, trade_date{extra}"
    level = {"none": None, "open": "daily_open", "vwap": "running_vwap"}[trend]
    up = f"{roc} >= 1.0" + (f" AND ltp > {level}" if level else "")
    down = f"{roc} <= -1.0" + (f" AND ltp < {level}" if level else "")
    return f"""a0 AS (SELECT *, row_number() OVER w AS rn, first_value(ltp) OVER w AS daily_open,
  sum(vwap_1m * volume_1m) OVER w / nullif(sum(volume_1m) OVER w, 0) AS running_vwap FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY ts)),
a1 AS (SELECT *, last_value(CASE WHEN pred <> 'NO_TRADE' THEN rn END IGNORE NULLS) OVER w AS a,
  last_value(CASE WHEN pred <> 'NO_TRADE' THEN pred END IGNORE NULLS) OVER w AS direction FROM a0 WINDOW w AS (PARTITION BY {part} ORDER BY ts)),
a2 AS (SELECT *, rn - a <= {_EXPIRY} AND CASE WHEN direction = 'LONG' THEN {up} ELSE {down} END AS ok FROM a1),
a3 AS (SELECT *, ok AND row_number() OVER (PARTITION BY {part}, a, ok ORDER BY rn) = 1 AS trig,
  max(ltp) OVER f AS hi, min(ltp) OVER f AS lo, last_value(ltp) OVER f AS eod, max(ltp) OVER h AS hi60, min(ltp) OVER h AS lo60
  FROM a2 WINDOW f AS (PARTITION BY {part} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    h AS (PARTITION BY {part} ORDER BY rn ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING)),
a4 AS (SELECT *, CASE WHEN direction = 'LONG' THEN (eod - ltp) / ltp ELSE -(eod - ltp) / ltp END AS pnl,
  CASE WHEN direction = 'LONG' THEN (hi - ltp) / ltp ELSE -(lo - ltp) / ltp END AS mfe, CASE WHEN direction = 'LONG' THEN (lo - ltp) / ltp ELSE -(hi - ltp) / ltp END AS mae,
  CASE WHEN direction = 'LONG' THEN (hi60 - ltp) / ltp ELSE -(lo60 - ltp) / ltp END AS mfe_60m, CASE WHEN direction = 'LONG' THEN (lo60 - ltp) / ltp ELSE -(hi60 - ltp) / ltp END AS mae_60m
  FROM a3 WHERE trig)"""


_AL = ["pnl", "mfe", "mae", "mfe_60m", "mae_60m"]
_SQL_PRED = f"p AS (SELECT *, {_PRED.format(t=_THETA)} AS pred FROM bars)"


def _register_alert(trend):
    @query(f"alert_trigger_{trend}", f"""WITH {SQL_BARS}, {_SQL_PRED}, {_sql_alerts(trend, src='p')}
SELECT symbol, trade_date, ts, {sql_clock()} AS entry_time_ist, direction, ltp AS entry_price, {', '.join(f'rd({c}, 6) AS {c}' for c in _AL)} FROM a4""")
    def run(spark, sf):
        return naive_ts(rounded(A.alert_trades(predicted(spark, sf), trend=trend, expiry=_EXPIRY), *_AL))
    return run


alert_none, alert_open, alert_vwap = (_register_alert(t) for t in ("none", "open", "vwap"))

_DET = [*_AL, "roc", "dist_low_high"]


def _sql_detail(src, extra=""):
    part = f"symbol, trade_date{extra}"
    return f"""{_sql_alerts('none', 'roc_3', src, extra)},
d0 AS (SELECT *, max(CASE WHEN pred = 'LONG' THEN rn END) OVER w AS la, max(CASE WHEN pred = 'SHORT' THEN rn END) OVER w AS sa,
  max(CASE WHEN pred <> 'NO_TRADE' THEN rn END) OVER b AS pa, last_value(CASE WHEN pred <> 'NO_TRADE' THEN pred END IGNORE NULLS) OVER b AS pd,
  max(CASE WHEN trig THEN rn END) OVER b AS pt, min(ltp) OVER w AS lowest, max(ltp) OVER w AS highest, {sql_clock()} AS clock
  FROM a3 WINDOW w AS (PARTITION BY {part} ORDER BY rn ROWS UNBOUNDED PRECEDING),
    b AS (PARTITION BY {part} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d1 AS (SELECT *, pred <> 'NO_TRADE' AND (pa IS NULL OR pd <> pred OR rn - pa > {_EXPIRY + 1} OR coalesce(pt >= pa, FALSE)) AS fresh,
  rn - la <= {_EXPIRY} AND roc_3 >= 1.0 AND ltp > daily_open AS okl, rn - sa <= {_EXPIRY} AND roc_3 <= -1.0 AND ltp < daily_open AS oks FROM d0),
d2 AS (SELECT *, max(CASE WHEN fresh THEN rn END) OVER (PARTITION BY {part} ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM d1),
det AS (SELECT x.symbol, x.trade_date, x.ts{extra.replace(', ', ', x.')}, x.clock AS entry_time_ist, x.direction, x.ltp AS entry_price, x.eod AS exit_price,
  pnl, mfe, mae, mfe_60m, mae_60m, x.prob_long, x.prob_short, x.roc_3 AS roc, x.daily_open, x.rn - x.a AS alert_distance,
  CASE WHEN x.direction = 'LONG' THEN (x.ltp - lowest) / lowest * 100.0 ELSE (highest - x.ltp) / highest * 100.0 END AS dist_low_high,
  CASE WHEN x.direction = 'LONG' THEN x.ltp > x.daily_open ELSE x.ltp < x.daily_open END AS daily_open_passed,
  (SELECT arg_min(y.clock, y.rn) FROM d2 y WHERE y.symbol = x.symbol AND y.trade_date = x.trade_date{' AND y.theta = x.theta' if extra else ''} AND y.rn >= x.run
    AND CASE WHEN x.direction = 'LONG' THEN y.okl ELSE y.oks END) AS open_trigger_time
  FROM d2 x JOIN (SELECT symbol, trade_date, rn{extra}, pnl, mfe, mae, mfe_60m, mae_60m FROM a4) USING (symbol, trade_date, rn{extra}) WHERE x.trig)"""


_DET_COLS = (f"symbol, trade_date, ts, entry_time_ist, direction, entry_price, exit_price, {', '.join(f'rd({c}, 6) AS {c}' for c in _DET)}, "
             "prob_long, prob_short, daily_open, alert_distance, daily_open_passed, open_trigger_time")


@query("alert_trigger_detail", f"WITH {SQL_BARS}, {_SQL_PRED}, {_sql_detail('p')} SELECT {_DET_COLS} FROM det")
def alert_trigger_detail(spark, sf):
    return naive_ts(rounded(A.alert_trade_details(predicted(spark, sf), expiry=_EXPIRY), *_DET))


_THETAS = [0.8, 0.85, 0.9, 0.95]
_TM = ["win_rate", "mean_return", "cumulative_return", "mean_mfe", "mean_mae", "mfe_ge_3pct", "mfe_ge_5pct"]
_SQL_SWEEP = f"p AS (SELECT *, {_PRED.format(t='theta')} AS pred FROM bars CROSS JOIN (SELECT unnest({_THETAS}::DOUBLE[]) AS theta))"


@query("threshold_sweep", f"""WITH {SQL_BARS}, {_SQL_SWEEP}, {_sql_detail('p', ', theta')}
SELECT theta, count(*) AS total_trades, {', '.join(f'rd({e}, 6) AS {n}' for n, e in zip(_TM, ['avg(CAST(pnl > 0 AS INT))', 'avg(pnl)', 'sum(pnl)', 'avg(mfe)', 'avg(mae)', 'avg(CAST(mfe >= 0.03 AS INT))', 'avg(CAST(mfe >= 0.05 AS INT))']))}
FROM det GROUP BY 1""")
def threshold_sweep(spark, sf):
    trades = A.threshold_sweep(scored_bars(spark, sf), _THETAS, expiry=_EXPIRY)
    return rounded(S.threshold_metrics(trades, ["theta"]), *_TM)


@query("fold_totals", f"""WITH {SQL_BARS}, {_SQL_PRED}, {_sql_alerts('open', src='p')},
 f AS (SELECT direction, trade_date, count(*) AS n, avg(CAST(pnl > 0 AS INT)) AS w, sum(pnl) AS s FROM a4 GROUP BY ALL)
SELECT direction, CAST(sum(n) AS BIGINT) AS total_trades, rd(sum(s), 6) AS cumulative_pnl, rd(avg(w), 6) AS mean_win_rate, count(*) AS active_folds FROM f GROUP BY 1""")
def fold_totals(spark, sf):
    t = A.alert_trades(predicted(spark, sf), trend="open", expiry=_EXPIRY)
    return rounded(S.fold_totals(t, ["direction"]), "cumulative_pnl", "mean_win_rate")


@query("symbol_minute_detail", f"""WITH {SQL_BARS},
 g AS (SELECT symbol, trade_date, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) AS ts FROM (SELECT symbol, trade_date, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY ALL)),
 c AS (SELECT symbol, trade_date, ts, last_value(close_price IGNORE NULLS) OVER ({_D}) AS close_price FROM g LEFT JOIN bars USING (symbol, trade_date, ts)),
 r AS (SELECT *, (close_price - lag(close_price, 9) OVER s) / lag(close_price, 9) OVER s * 100.0 AS roc_9 FROM c WINDOW s AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, trade_date, ts, strftime(ts + INTERVAL '330 minutes', '%H:%M:%S') AS time_ist, rd(bars.ltp, 2) AS ltp, rd(r.close_price, 2) AS close_price,
  bars.prob_long, bars.prob_short, rd(r.roc_9, 4) AS roc_9 FROM bars JOIN r USING (symbol, trade_date, ts)""")
def symbol_minute_detail(spark, sf):
    from tidemark.catalog.inputs import BAR
    from tidemark.functions.clock import exchange_time
    from tidemark.operators.bars import minute_grid

    bars = scored_bars(spark, sf)
    line = minute_grid(bars.select(*_HEAD, "close_price"), bar=BAR)
    line = line.withColumn("roc_9", M.roc(9, keys=("symbol",), fill=None))
    out = bars.select(*_HEAD, "ltp", "prob_long", "prob_short").join(line, _HEAD)
    return naive_ts(out.select(*_HEAD, exchange_time("ts").alias("time_ist"), rd("ltp", 2).alias("ltp"),
                               rd("close_price", 2).alias("close_price"), "prob_long", "prob_short", rd("roc_9", 4).alias("roc_9")))


# --------------------------------------------------------------------------- rules

_RH = (4, 8)
_q = {0.1: 0, 0.2: 1, 0.8: 2, 0.9: 3}


def _sql_rules():
    feats = R.RULE_INPUTS
    qs = ", ".join(f"quantile_cont({f}, {p}) AS q{i}_{f}" for f in feats for p, i in _q.items())
    ok = lambda f, h: f"count(DISTINCT CASE WHEN return_{h}m IS NOT NULL THEN {f} END) > 1 AND count(DISTINCT CASE WHEN {f} IS NOT NULL THEN return_{h}m END) > 1"
    cs = ", ".join(f"CASE WHEN {ok(f, h)} THEN corr({f}, return_{h}m) END AS c_{f}_{h}" for f in feats for h in _RH)
    rows = []

    def add(h, feature, name, test, hi="NULL", lo="NULL"):
        rows.append(f"SELECT symbol, trade_date, ts, ltp AS entry_price, {', '.join(feats)}, CAST({h} AS BIGINT) AS horizon, '{feature}' AS feature, {name} AS rule_name, "
                    f"return_{h}m AS forward_return, {label_name(h, 0.03)} AS label, CAST({hi} AS DOUBLE) AS threshold_high, CAST({lo} AS DOUBLE) AS threshold_low FROM rt WHERE {test}")

    for h in _RH:
        for f in feats:
            c = f"c_{f}_{h}"
            add(h, f, f"CASE WHEN {c} >= 0 THEN 'top_decile_long' ELSE 'top_decile_short' END", f"{c} IS NOT NULL AND {f} >= q3_{f}", hi=f"q3_{f}")
            add(h, f, f"CASE WHEN {c} >= 0 THEN 'bottom_decile_short' ELSE 'bottom_decile_long' END", f"{c} IS NOT NULL AND {f} <= q0_{f}", lo=f"q0_{f}")
        for f in R.PERCENTILE_INPUTS:
            for name, op, i in (("thresh_>=90pct", ">=", 3), ("thresh_>=80pct", ">=", 2), ("thresh_<=10pct", "<=", 0), ("thresh_<=20pct", "<=", 1)):
                add(h, f, f"'{name}'", f"{f} {op} q{i}_{f}", **({"hi": f"q{i}_{f}"} if op == ">=" else {"lo": f"q{i}_{f}"}))
        for a, b in R.PAIRED_INPUTS:
            side = lambda f: f"CASE WHEN coalesce(c_{f}_{h} >= 0, FALSE) THEN {f} >= q3_{f} ELSE {f} <= q0_{f} END"
            add(h, f"{a}+{b}", "'top_decile_and'", f"{side(a)} AND {side(b)}")
    return f"rt AS (SELECT * FROM rb JOIN (SELECT symbol, trade_date, {qs}, {cs} FROM rb GROUP BY ALL) USING (symbol, trade_date)), rules AS ({' UNION ALL '.join(rows)})"


_SQL_RB = f"""rb AS (SELECT *, CAST(sum(delta_1m) OVER (PARTITION BY symbol, trade_date ORDER BY ts ROWS 4 PRECEDING) AS BIGINT) AS delta_5m,
  CASE WHEN avg(trade_count_1m) OVER w20 > 0 THEN trade_count_1m / avg(trade_count_1m) OVER w20 ELSE 1.0 END AS trade_count_burst, high_price - low_price AS spread
  FROM labelled WINDOW w20 AS (PARTITION BY symbol, trade_date ORDER BY ts ROWS 19 PRECEDING))"""


@query("rule_signals", f"""WITH {SQL_BARS}, {SQL_LABELS}, {_SQL_RB}, {_sql_rules()}
SELECT horizon, feature, rule_name, count(*) AS n, rd(avg(forward_return), 8) AS mean_return, rd(avg(threshold_high), 4) AS mean_high, rd(avg(threshold_low), 4) AS mean_low,
  count(*) FILTER (WHERE label = 'LONG') AS longs FROM rules GROUP BY ALL""")
def rule_signals(spark, sf):
    bars = labelled_bars(spark, sf).withColumn("spread", F.col("high_price") - F.col("low_price"))
    s = R.rule_signals(bars, _RH)
    return s.groupBy("horizon", "feature", "rule_name").agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("forward_return"), 8).alias("mean_return"),
        rd(F.avg("threshold_high"), 4).alias("mean_high"), rd(F.avg("threshold_low"), 4).alias("mean_low"),
        F.count_if(F.col("label") == "LONG").alias("longs"))


# --------------------------------------------------------------------------- holds

_HOLD, _HEXP, _LIMIT = (4, 8), (2, 5), 0.01


def _sql_hold(name, part, hold, expiry, mode, start):
    """The sequential rule bar by bar: one recursion step per bar of every group at once."""
    join = " AND ".join(f"b.{k} = s.{k}" for k in part)
    cols = ", ".join(f"b.{k}" for k in part)
    armed = {
        "model": "b.side",
        "roc": f"CASE WHEN b.rn > 9 AND b.move >= {_LIMIT} THEN 1 WHEN b.rn > 9 AND b.move <= -{_LIMIT} THEN -1 ELSE 0 END",
        "model_roc": f"CASE WHEN b.rn <= {start} THEN 0 WHEN b.side <> 0 THEN b.side WHEN b.rn - s.since > {expiry} THEN 0 ELSE s.armed END",
    }[mode]
    fires = {"model": "armed <> 0", "roc": "armed <> 0", "model_roc": f"armed <> 0 AND move * armed >= {_LIMIT}"}[mode]
    since = f"CASE WHEN b.rn > {start} AND b.side <> 0 THEN b.rn ELSE s.since END"
    return f"""{name} AS (
  SELECT {', '.join(part)}, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS until, 0 AS armed, CAST(0 AS BIGINT) AS since, FALSE AS fired, 0 AS dir, CAST(0 AS BIGINT) AS alert_rn FROM (SELECT DISTINCT {', '.join(part)} FROM hb)
  UNION ALL
  SELECT {', '.join(part)}, rn, CASE WHEN fired THEN least(rn + {hold}, cnt) ELSE until END, CASE WHEN fired THEN 0 ELSE armed END, since, fired, CASE WHEN fired THEN armed ELSE 0 END, CASE WHEN fired THEN since ELSE 0 END
  FROM (SELECT *, free AND {fires} AS fired FROM (
    SELECT {cols}, b.rn, b.cnt, b.move, s.until, b.rn > s.until AS free, CASE WHEN b.rn > s.until THEN {armed} ELSE 0 END AS armed,
      CASE WHEN b.rn > s.until THEN {since} ELSE s.since END AS since
    FROM {name} s JOIN hb b ON {join} AND b.rn = s.rn + 1)))"""


def _sql_hb(part):
    p = ", ".join(part)
    return f"""hb AS (SELECT *, coalesce((ltp - lag(ltp, 9) OVER w) / lag(ltp, 9) OVER w, 0.0) AS move, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {p}) AS cnt,
  CASE pred WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 ELSE 0 END AS side FROM p WINDOW w AS (PARTITION BY {p} ORDER BY ts))"""


def _sql_hold_rows(name, part, strategy, hold, expiry, alert):
    on = " AND ".join(f"h.{k} = {{x}}.{k}" for k in part)
    a = f"(SELECT ts FROM hb x WHERE {on.format(x='x')} AND x.rn = h.alert_rn)" if alert else "CAST(NULL AS TIMESTAMP)"
    return f"""SELECT {', '.join('h.' + k for k in part)}, '{strategy}' AS strategy, CAST({hold} AS BIGINT) AS horizon, CAST({expiry if expiry is not None else 'NULL'} AS BIGINT) AS expiry,
  {a} AS alert_ts, e.ts AS entry_ts, x.ts AS exit_ts, CASE WHEN dir > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, e.ltp AS entry_price, x.ltp AS exit_price,
  rd((x.ltp - e.ltp) / e.ltp * dir, 6) AS pnl, rd(CASE WHEN e.rn > 9 THEN e.move * 100.0 END, 6) AS roc_at_entry
  FROM {name} h JOIN hb e ON {on.format(x='e')} AND e.rn = h.rn JOIN hb x ON {on.format(x='x')} AND x.rn = h.until WHERE h.fired"""


_DAY = ["symbol", "trade_date"]
_hold_out = lambda df: naive_ts(rounded(df, "pnl", "roc_at_entry"), "alert_ts", "entry_ts", "exit_ts")


def _hold_sql(mode):
    expiries = _HEXP if mode == "model_roc" else (None,)
    combos = [(f"h{i}", h, e) for i, (h, e) in enumerate((h, e) for h in _HOLD for e in expiries)]
    ctes = ", ".join(_sql_hold(n, _DAY, h, e if e is not None else 0, mode, 9) for n, h, e in combos)
    rows = " UNION ALL ".join(_sql_hold_rows(n, _DAY, mode, h, e, mode == "model_roc") for n, h, e in combos)
    return ctes, rows


for _name, _mode in (("hold_model_alone", "model"), ("hold_roc_alone", "roc"), ("hold_alert_roc", "model_roc")):
    def _make(name, mode):
        ctes, rows = _hold_sql(mode)
        rows = rows if mode != "model" else rows.replace("CAST(NULL AS TIMESTAMP) AS alert_ts", "e.ts AS alert_ts")

        @query(name, f"WITH RECURSIVE {SQL_BARS}, {_SQL_PRED}, {_sql_hb(_DAY)}, {ctes} {rows}")
        def run(spark, sf):
            return _hold_out(H.hold_trades(predicted(spark, sf), strategies=(mode,), horizons=_HOLD, expiries=_HEXP, limit=_LIMIT))
        return run
    _make(_name, _mode)


@query("hold_sweep", f"""WITH RECURSIVE {SQL_BARS}, {_SQL_PRED}, {_sql_hb(_DAY)}, {_hold_sql('model_roc')[0]}, t AS ({_hold_sql('model_roc')[1].replace('rd((x.ltp - e.ltp) / e.ltp * dir, 6) AS pnl', '(x.ltp - e.ltp) / e.ltp * dir AS pnl')})
SELECT strategy, horizon, expiry, count(*) AS num_trades, round(avg(CAST(pnl > 0 AS INT)), 4) AS win_rate, round(avg(pnl), 6) AS mean_pnl, round(quantile_cont(pnl, 0.5), 6) AS median_pnl,
  round(CASE WHEN abs(sum(pnl) FILTER (WHERE pnl <= 0)) > 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0.0) / abs(sum(pnl) FILTER (WHERE pnl <= 0))
    WHEN sum(pnl) FILTER (WHERE pnl > 0) > 0 THEN sum(pnl) FILTER (WHERE pnl > 0) ELSE 1.0 END, 4) AS profit_factor, round(sum(pnl), 6) AS cumulative_pnl FROM t GROUP BY ALL""")
def hold_sweep(spark, sf):
    trades = H.hold_trades(predicted(spark, sf), strategies=("model_roc",), horizons=_HOLD, expiries=_HEXP, limit=_LIMIT)
    return S.trade_metrics(trades, ["strategy", "horizon", "expiry"])


@query("best_config", f"""SELECT * FROM ({SQL['hold_sweep']}) ORDER BY CASE WHEN num_trades >= 20 THEN 0 ELSE 1 END, mean_pnl DESC, horizon, expiry LIMIT 1""")
def best_config(spark, sf):
    trades = H.hold_trades(predicted(spark, sf), strategies=("model_roc",), horizons=_HOLD, expiries=_HEXP, limit=_LIMIT)
    return best_row(S.trade_metrics(trades, ["strategy", "horizon", "expiry"]),
                    [F.desc("mean_pnl"), "horizon", "expiry"], F.col("num_trades") >= 20)


@query("hold_no_expiry", f"""WITH RECURSIVE {SQL_BARS}, {_SQL_PRED}, {_sql_hb(['symbol'])}, {_sql_hold('h0', ['symbol'], 20, 10 ** 9, 'model_roc', 1)}
{_sql_hold_rows('h0', ['symbol'], 'model_roc', 20, None, True)}""")
def hold_no_expiry(spark, sf):
    return _hold_out(H.hold_without_expiry(predicted(spark, sf), horizon=20))


@query("gate_trace")
def gate_trace(spark, sf):
    return naive_ts(H.gate_trace(scored_bars(spark, sf), theta=_THETA, bypasses=True, expiry=_EXPIRY))
