"""Queries for forward paths, controls, score statistics, splits, metrics, models and comparisons."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.bars_features import SQL_LABELS, labelled_bars
from tidemark.catalog.events import (
    CLUSTER_ROUNDED, SQL_CLUSTER, _PRED, _THETA, predicted,
)
from tidemark.catalog.inputs import (
    Registry, SQL_BARS, naive_ts, rd, rounded, scored_bars, sql_clock,
)
from tidemark.models import oof as O
from tidemark.models.audit import prediction_audit as prediction_audit_table
from tidemark.models import splits as P
from tidemark.models import store as V
from tidemark.operators import compare as C
from tidemark.operators import metrics as X
from tidemark.operators import paths as H
from tidemark.operators import stats as S
from tidemark.operators.labels import forward_return
from tidemark.operators.momentum import with_trailing_volatility
from tidemark.operators.ranks import decile_of, exact_quantiles, global_rank, top_fraction
from tidemark.session import checkpoint_dir, stage
from tidemark.sources.sinks import write_results

query = Registry()
QUERIES, SQL = query.queries, query.sql

_D = "PARTITION BY symbol, trade_date ORDER BY ts"
_HEAD = ["symbol", "trade_date", "ts"]

# A score whose best rows sit in few symbols, so that quiet symbols remain as controls.
_SYM = "CAST(substr(symbol, 2) AS BIGINT)"
_SCORE = f"(({_SYM} * 7) % 16) + prob_long"
SQL_SCORED = f"sb AS (SELECT *, {_SCORE} AS score, {_SYM} * 100000 + n AS id FROM bars)"


def ranked_bars(spark, sf):
    return stage(scored_bars(spark, sf)).withColumns({"score": F.expr(_SCORE), "id": F.expr(f"{_SYM} * 100000 + bar_no")})


def _sql_top(src, score, fraction, at_least=1, name="sig", where="TRUE"):
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, trade_date, symbol, ts) AS rk, count(*) OVER () AS rn_all "
            f"FROM {src} WHERE {where}) WHERE rk <= greatest({at_least}, floor(rn_all * {fraction})))")


# --------------------------------------------------------------------------- forward paths

def _sql_moves(name, sig, direction, price=("high_price", "low_price", "close_price"), entry="close_price", extra=""):
    """Excursions from a self-join of signals with later bars of the day."""
    h, l, c = price
    up = f"(b.{h} - s.{entry}) / s.{entry} * 10000.0" if direction == "LONG" else f"(b.{l} - s.{entry}) / s.{entry} * -10000.0"
    dn = f"(b.{l} - s.{entry}) / s.{entry} * 10000.0" if direction == "LONG" else f"(b.{h} - s.{entry}) / s.{entry} * -10000.0"
    rt = f"(b.{c} - s.{entry}) / s.{entry} * {'10000.0' if direction == 'LONG' else '-10000.0'}"
    return f"""{name}_p AS (SELECT s.id, s.symbol, s.trade_date, s.ts{extra}, {up} AS up, {dn} AS dn, {rt} AS rt, s.{entry} AS p0, b.{c} AS c,
    row_number() OVER (PARTITION BY s.id, s.symbol, s.ts{extra} ORDER BY b.ts) AS k FROM {sig} s JOIN bars b ON s.symbol = b.symbol AND s.trade_date = b.trade_date AND b.ts > s.ts),
{name}_m AS (SELECT *, max(up) OVER q AS mfe, min(dn) OVER q AS mae, count(*) OVER q AS nb,
    power((ln(c) - ln(coalesce(lag(c) OVER (PARTITION BY id, symbol, ts{extra.replace('s.', '')} ORDER BY k), p0))) * 10000.0, 2) AS v
  FROM {name}_p WINDOW q AS (PARTITION BY id, symbol, ts{extra.replace('s.', '')})),
{name}_i AS (SELECT *, min(CASE WHEN up = mfe THEN k END) OVER (PARTITION BY id, symbol, ts{extra.replace('s.', '')}) AS mk FROM {name}_m),
{name} AS (SELECT id, symbol, trade_date, ts{extra.replace('s.', '')}, max(mfe) AS mfe_bps, max(mk) AS mfe_minute, max(mae) AS mae_bps, min(CASE WHEN dn = mae THEN k END) AS mae_minute,
  min(CASE WHEN k <= mk THEN dn END) AS mae_before_mfe_bps, arg_max(rt, CASE WHEN k <= 60 THEN k END) AS ret_60m_bps, arg_max(rt, k) AS ret_eod_bps,
  max(nb) AS bars_to_close, abs(arg_max(rt, CASE WHEN k <= 60 THEN k END)) AS abs_ret_60m_bps, abs(arg_max(rt, k)) AS abs_ret_eod_bps,
  sum(CASE WHEN k <= 60 THEN v ELSE 0.0 END) AS realized_var_60m FROM {name}_i GROUP BY ALL)"""


_M = H.METRICS
_INT = {"mfe_minute", "mae_minute", "bars_to_close"}
_mcols = lambda cols, p=4: ", ".join(c if c in _INT else f"rd({c}, {p}) AS {c}" for c in cols)
_moves = lambda df, cols: naive_ts(rounded(df.select("id", *_HEAD, *cols), *[c for c in cols if c not in _INT], places=4))


@query("excursion_profile", f"""WITH {SQL_BARS}, {SQL_SCORED}, {_sql_top('sb', 'prob_long', 0.1)}, {_sql_moves('mv', 'sig', 'LONG', ('ltp', 'ltp', 'ltp'), 'ltp')}
SELECT id, symbol, trade_date, ts, {_mcols(_M)} FROM mv""")
def excursion_profile(spark, sf):
    b = ranked_bars(spark, sf)
    top = top_fraction(b, "prob_long", 0.1, ["symbol", "ts"])
    return _moves(H.excursions(top, b, "LONG", "ltp", "ltp", "ltp", "ltp"), _M)


@query("excursion_distribution", f"""WITH {SQL_BARS}, {SQL_SCORED}, {_sql_top('sb', 'prob_short', 0.1)}, {_sql_moves('mv', 'sig', 'SHORT')},
 lg AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM mv" for m in _M)})
SELECT metric, count(*) AS n, round(avg(value), 2) AS mean, {', '.join(f'round(quantile_cont(value, {q}), 2) AS {n}' for q, n in ((0.05, 'p5'), (0.25, 'p25'), (0.5, 'p50'), (0.75, 'p75'), (0.95, 'p95')))}
FROM lg GROUP BY 1""")
def excursion_distribution(spark, sf):
    b = ranked_bars(spark, sf)
    return H.excursion_distribution(H.excursions(top_fraction(b, "prob_short", 0.1, ["symbol", "ts"]), b, "SHORT"))


@query("excursion_diagnostics", f"""WITH {SQL_BARS}, {SQL_SCORED}, {_sql_top('sb', 'prob_long', 0.1)}, {_sql_moves('mv', 'sig', 'LONG')},
 q AS (SELECT symbol, quantile_cont(mfe_bps, 0.5) AS a, quantile_cont(ret_eod_bps, 0.5) AS e, quantile_cont(mae_bps, 0.5) AS w FROM mv GROUP BY 1)
SELECT symbol, rd(a - e, 4) AS giveback_bps, rd(CASE WHEN a > 0 THEN (a - e) / a * 100 ELSE 0.0 END, 4) AS giveback_pct, rd(CASE WHEN abs(w) > 0 THEN a / abs(w) ELSE 0.0 END, 4) AS mfe_mae_ratio FROM q""")
def excursion_diagnostics(spark, sf):
    b = ranked_bars(spark, sf)
    moves = H.excursions(top_fraction(b, "prob_long", 0.1, ["symbol", "ts"]), b, "LONG")
    return rounded(H.excursion_diagnostics(moves, ["symbol"]), "giveback_bps", "giveback_pct", "mfe_mae_ratio", places=4)


@query("realized_variance", f"""WITH {SQL_BARS}, {SQL_SCORED}, {_sql_top('sb', 'prob_long', 0.1)}, {_sql_moves('mv', 'sig', 'LONG')}
SELECT id, symbol, trade_date, ts, {_mcols(H.VARIANCE_METRICS)} FROM mv""")
def realized_variance(spark, sf):
    b = ranked_bars(spark, sf)
    return _moves(H.excursions(top_fraction(b, "prob_long", 0.1, ["symbol", "ts"]), b, "LONG"), H.VARIANCE_METRICS)


# --------------------------------------------------------------------------- controls

_DRAW = H.Draw(order=lambda c: (c * 104729) % 1000003, begin=lambda s: (s * 7919) % 1000003)


_PAIRS = H.PairDraw(lambda s, c: (s * 7919 + c * 104729) % 1000003)
_SQL_PAIRS = "(s.id * 7919 + c.id * 104729) % 1000003"


def _ids(draw=_DRAW):
    return {"draw": draw, "signal_id": F.col("id"), "control_id": F.col("id")}


def _sql_controls(match, fallback=None, n=20, src="sb", sig="sig"):
    on = lambda keys: " AND ".join(f"s.{k} = c.{k}" for k in keys)
    placed = lambda keys: f"(SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY (id * 104729) % 1000003, id) - 1 AS place, count(*) OVER (PARTITION BY {', '.join(keys)}) AS size FROM quiet)"
    turn = "(c.place - (s.id * 7919) % 1000003 % c.size + c.size) % c.size + 1 AS draw_no"
    fall = "" if fallback is None else f""" UNION ALL SELECT s.id AS sid, c.*, {turn} FROM {sig} s JOIN {placed(fallback)} c ON {on(fallback)}
    WHERE NOT EXISTS (SELECT 1 FROM quiet c2 WHERE {' AND '.join(f's.{k} = c2.{k}' for k in match)})"""
    return f"""quiet AS (SELECT * FROM {src} WHERE symbol NOT IN (SELECT symbol FROM sig)),
cand AS (SELECT s.id AS sid, c.*, {turn} FROM {sig} s JOIN {placed(match)} c ON {on(match)}{fall}),
ctl AS (SELECT * FROM cand WHERE draw_no <= {n})"""


def _sql_ranked_controls(match, fallback=None, n=20, src="sb"):
    """Every signal ranks all candidates of its key."""
    on = lambda keys: " AND ".join(f"s.{k} = c.{k}" for k in keys)
    fall = "" if fallback is None else f""" UNION ALL SELECT s.id AS sid, c.*, {_SQL_PAIRS} AS o FROM sig s JOIN quiet c ON {on(fallback)}
    WHERE NOT EXISTS (SELECT 1 FROM quiet c2 WHERE {' AND '.join(f's.{k} = c2.{k}' for k in match)})"""
    return f"""quiet AS (SELECT * FROM {src} WHERE symbol NOT IN (SELECT symbol FROM sig)),
cand AS (SELECT s.id AS sid, c.*, {_SQL_PAIRS} AS o FROM sig s JOIN quiet c ON {on(match)}{fall}),
ctl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY o, id) AS draw_no FROM cand) WHERE draw_no <= {n})"""


_CTL_OUT = "SELECT sid AS signal_id, trade_date, draw_no, symbol, ts, close_price FROM ctl"


@query("matched_controls", f"""WITH {SQL_BARS}, {SQL_SCORED}, {_sql_top('sb', 'score', 0.02)}, {_sql_ranked_controls(['trade_date', 'ts'], n=5)} {_CTL_OUT}""")
def matched_controls(spark, sf):
    b = ranked_bars(spark, sf)
    sig = top_fraction(b, "score", 0.02, ["symbol", "ts"]).drop("rn", "n")
    return naive_ts(H.matched_controls(sig, b, ["trade_date", "ts"], n=5, **_ids(_PAIRS)))


SQL_VOL = f"""vr AS (SELECT *, (close_price - lag(close_price) OVER s) / lag(close_price) OVER s AS ret_1m FROM sb WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
vv AS (SELECT *, CASE WHEN count(ret_1m) OVER w >= 5 THEN stddev_samp(ret_1m) OVER w * 10000.0 END AS vol_raw FROM vr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
vm AS (SELECT *, rd(coalesce(vol_raw, (SELECT quantile_cont(vol_raw, 0.5) FROM vv)), 4) AS vol_20m FROM vv),
vd AS (SELECT *, CASE WHEN m > 1 THEN greatest(1, ((k - 1) * 10 + (m - 2)) // (m - 1)) ELSE 1 END AS vol_decile FROM (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY vol_20m, symbol, ts) AS k, count(*) OVER (PARTITION BY trade_date) AS m FROM vm))"""


def vol_bars(spark, sf):
    b = stage(with_trailing_volatility(ranked_bars(spark, sf)).withColumn("vol_20m", rd("vol_20m", 4)))
    b = global_rank(b, "vol_20m", ["symbol", "ts"], ["trade_date"])
    return b.withColumn("vol_decile", decile_of("rn", "n")).drop("rn", "n")


@query("vol_deciles", f"WITH {SQL_BARS}, {SQL_SCORED}, {SQL_VOL} SELECT symbol, trade_date, ts, vol_20m, vol_decile FROM vd")
def vol_deciles(spark, sf):
    return naive_ts(vol_bars(spark, sf).select(*_HEAD, "vol_20m", "vol_decile"))


@query("vol_matched_controls", f"""WITH {SQL_BARS}, {SQL_SCORED}, {SQL_VOL}, {_sql_top('vd', 'score', 0.02)},
{_sql_ranked_controls(['trade_date', 'ts', 'vol_decile'], ['trade_date', 'ts'], 5, 'vd')} {_CTL_OUT}""")
def vol_matched_controls(spark, sf):
    b = vol_bars(spark, sf)
    sig = top_fraction(b, "score", 0.02, ["symbol", "ts"]).drop("rn", "n")
    return naive_ts(H.matched_controls(sig, b, ["trade_date", "ts", "vol_decile"], ["trade_date", "ts"], 5, **_ids(_PAIRS)))


_LIFT = [m for m in _M if m != "bars_to_close"]
_sql_long = lambda m, g, cols: " UNION ALL ".join(f"SELECT trade_date, '{g}' AS grp, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {m}" for c in cols)


def _sql_lift(cols, vol):
    src = "vd" if vol else "sb"
    match = ["trade_date", "ts", "vol_decile"] if vol else ["trade_date", "ts"]
    return f"""WITH {SQL_BARS}, {SQL_SCORED}, {SQL_VOL + ',' if vol else ''} {_sql_top(src, 'score', 0.02)},
followed AS (SELECT * FROM sig WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = sig.symbol AND b.trade_date = sig.trade_date AND b.ts > sig.ts)),
{_sql_controls(match, ['trade_date', 'ts'] if vol else None, 20, src, 'followed')},
 cc AS (SELECT sid AS id, symbol, trade_date, ts, close_price FROM ctl),
{_sql_moves('ms', 'sig', 'LONG')}, {_sql_moves('mc', 'cc', 'LONG')},
 lg AS ({_sql_long('ms', 'A', cols)} UNION ALL {_sql_long('mc', 'B', cols)}),
{SQL_CLUSTER.format(name='res', by='metric', src='lg')} SELECT * FROM res"""


@query("control_lift", _sql_lift(_LIFT, False))
def control_lift(spark, sf):
    return rounded(H.control_lift(ranked_bars(spark, sf), "score", fraction=0.02, **_ids()), *CLUSTER_ROUNDED, places=4)


_VARS = H.VARIANCE_METRICS + ["mfe_bps", "mae_bps", "ret_60m_bps", "ret_eod_bps"]


@query("variance_lift", _sql_lift(_VARS, True))
def variance_lift(spark, sf):
    out = H.control_lift(vol_bars(spark, sf), "score", fraction=0.02, match=("trade_date", "minute_of_day", "vol_decile"),
                         fallback=("trade_date", "minute_of_day"), metrics=_VARS, **_ids())
    return rounded(out, *CLUSTER_ROUNDED, places=4)


@query("clustered_t", f"""WITH {SQL_BARS}, v AS (SELECT trade_date, CASE WHEN prob_long >= 0.5 THEN 'A' ELSE 'B' END AS grp, symbol, delta_1m AS value FROM bars),
{SQL_CLUSTER.format(name='res', by='symbol', src='v')} SELECT * FROM res""")
def clustered_t(spark, sf):
    from tidemark.operators.study import clustered_t as compare
    v = scored_bars(spark, sf).select("trade_date", "symbol", F.when(F.col("prob_long") >= 0.5, "A").otherwise("B").alias("grp"),
                                      F.col("delta_1m").alias("value"))
    return rounded(compare(v, ["symbol"]), *CLUSTER_ROUNDED, places=4)


# --------------------------------------------------------------------------- deciles, tails, segments, timing

SQL_FWD = f"""fw AS (SELECT *, (lead(ltp, 16) OVER s - ltp) / ltp * 10000.0 AS fwd, (lead(close_price, 16) OVER s - close_price) / close_price * 10000.0 AS ret_60m_bps
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts))"""
_RK = """rk AS (SELECT *, {sign} * fwd AS ret, row_number() OVER (ORDER BY {score} DESC, trade_date, symbol, ts) AS rn, count(*) OVER () AS m FROM fw WHERE fwd IS NOT NULL)"""
_STAT = ("count(*) AS rows, round(avg(ret), 2) AS mean_bps, round(stddev_pop(ret), 2) AS std_bps, "
         "round(avg(CAST(ret > 100.0 AS INT)) * 100, 2) AS share_gt_100bps, round(avg(CAST(ret < -100.0 AS INT)) * 100, 2) AS share_lt_minus_100bps, "
         "round(quantile_cont(ret, 0.5), 2) AS median_bps, round(quantile_cont(ret, 0.05), 2) AS p5_bps, round(quantile_cont(ret, 0.95), 2) AS p95_bps")


def forward_bars(spark, sf):
    b = stage(scored_bars(spark, sf))
    return b.withColumns({"fwd": forward_return(16, "ltp", ("symbol",)) * 10000.0,
                          "ret_60m_bps": forward_return(16, "close_price", ("symbol",)) * 10000.0})


@query("decile_table", f"""WITH {SQL_BARS}, {SQL_FWD}, {_RK.format(sign=1, score='prob_long')}
SELECT greatest(1, ((rn - 1) * 10 + (m - 2)) // (m - 1)) AS decile, {_STAT} FROM rk GROUP BY 1""")
def decile_table(spark, sf):
    return S.decile_table(S.ranked_returns(forward_bars(spark, sf), "prob_long", "fwd"))


@query("tail_buckets", f"""WITH {SQL_BARS}, {SQL_FWD}, {_RK.format(sign=-1, score='prob_short')},
 tb AS ({' UNION ALL '.join(f"SELECT '{n}' AS bucket, * FROM rk WHERE rn <= greatest({lo}, floor(m * {p}))" for n, p, lo in S.TAILS)})
SELECT bucket, {_STAT} FROM tb GROUP BY 1""")
def tail_buckets(spark, sf):
    return S.tail_buckets(S.ranked_returns(forward_bars(spark, sf), "prob_short", "fwd", "SHORT"))


_SEG = """seg AS (SELECT symbol, mean_price, row_number() OVER (ORDER BY mean_price DESC, symbol) AS rank FROM (SELECT symbol, rd(avg(ltp), 6) AS mean_price FROM bars GROUP BY 1)),
 sg AS (SELECT *, CASE WHEN rank <= 5 THEN 'TOP' WHEN rank <= 11 THEN 'NEXT' ELSE 'REST' END AS segment FROM seg)"""


@query("liquidity_segments", f"WITH {SQL_BARS}, {_SEG} SELECT symbol, mean_price, rank, segment FROM sg")
def liquidity_segments(spark, sf):
    return rounded(S.liquidity_segments(scored_bars(spark, sf), 5, 6), "mean_price")


@query("segment_deciles", f"""WITH {SQL_BARS}, {SQL_FWD}, {_SEG},
 rk AS (SELECT *, fwd AS ret, row_number() OVER (PARTITION BY segment ORDER BY prob_long DESC, trade_date, symbol, ts) AS rn, count(*) OVER (PARTITION BY segment) AS m
  FROM fw JOIN sg USING (symbol) WHERE fwd IS NOT NULL)
SELECT segment, greatest(1, ((rn - 1) * 10 + (m - 2)) // (m - 1)) AS decile, {_STAT} FROM rk GROUP BY ALL""")
def segment_deciles(spark, sf):
    seg = S.liquidity_segments(scored_bars(spark, sf), 5, 6).select("symbol", "segment")
    ranked = S.ranked_returns(forward_bars(spark, sf).join(seg, "symbol"), "prob_long", "fwd", by=["segment"])
    return S.decile_table(ranked, ["segment"])


@query("spread_segments", f"""WITH {SQL_BARS}, m AS (SELECT symbol, rd(avg(high_price - low_price), 6) AS mean_spread FROM bars GROUP BY 1),
 q AS (SELECT quantile_cont(mean_spread, 0.5) AS median_spread FROM m)
SELECT symbol, mean_spread, rd(median_spread, 6) AS median_spread, CASE WHEN mean_spread <= median_spread THEN 'TIGHT' ELSE 'WIDE' END AS segment FROM m, q""")
def spread_segments(spark, sf):
    b = scored_bars(spark, sf).withColumn("spread", F.col("high_price") - F.col("low_price"))
    return rounded(S.spread_segments(b), "mean_spread", "median_spread")


@query("top_fraction", f"WITH {SQL_BARS}, {_sql_top('bars', 'prob_long', 0.01)} SELECT symbol, trade_date, ts, prob_long, rk AS rn FROM sig")
def top_rows(spark, sf):
    b = scored_bars(spark, sf)
    return naive_ts(top_fraction(b, "prob_long", 0.01, ["symbol", "ts"]).select(*_HEAD, "prob_long", "rn"))


_BK = "strftime(ts, '%H') || ':' || lpad(CAST(minute(ts) - minute(ts) % 15 AS VARCHAR), 2, '0')"


@query("bucket_15m", f"""WITH {SQL_BARS}, {_sql_top('bars', 'prob_long', 0.05, name='l')}, {_sql_top('bars', 'prob_short', 0.05, name='s')},
 u AS (SELECT {_BK} AS bucket, 1 AS is_long FROM l UNION ALL SELECT {_BK}, 0 FROM s),
 c AS (SELECT bucket, count(*) FILTER (WHERE is_long = 1) AS long_n, count(*) FILTER (WHERE is_long = 0) AS short_n FROM u GROUP BY 1)
SELECT bucket, long_n, short_n, rd(long_n * 100.0 / sum(long_n) OVER (), 6) AS long_pct, rd(short_n * 100.0 / sum(short_n) OVER (), 6) AS short_pct FROM c""")
def bucket_15m(spark, sf):
    b = scored_bars(spark, sf)
    top = lambda c: top_fraction(b, c, 0.05, ["symbol", "ts"])
    return rounded(S.bucket_15m(top("prob_long"), top("prob_short")), "long_pct", "short_pct")


@query("opening_slots", f"""WITH {SQL_BARS}, {_sql_top('bars', 'prob_long', 0.3)},
 d AS (SELECT trade_date, count(*) FILTER (WHERE {sql_clock()} >= '09:15:00' AND {sql_clock()} < '09:30:00') AS o, count(*) FILTER (WHERE minute(ts) < 30) AS h FROM sig GROUP BY 1)
SELECT count(*) AS days, quantile_cont(o, 0.5) AS median_opening, rd(avg(CAST(o >= 10 AS INT)) * 100, 6) AS pct_days_opening_full,
  quantile_cont(h, 0.5) AS median_half_hour, rd(avg(CAST(h >= 10 AS INT)) * 100, 6) AS pct_days_half_hour_full FROM d""")
def opening_slots(spark, sf):
    top = top_fraction(scored_bars(spark, sf), "prob_long", 0.3, ["symbol", "ts"])
    return rounded(S.opening_slots(top), "pct_days_opening_full", "pct_days_half_hour_full")


@query("screener_baseline", f"""WITH {SQL_BARS}, {SQL_FWD}, kn AS (SELECT * FROM fw WHERE ret_60m_bps IS NOT NULL), {_sql_top('kn', 'prob_long', 0.01, 0)},
 ea AS (SELECT *, row_number() OVER (ORDER BY rd(volume_burst, 9) DESC, trade_date, symbol, ts) AS k FROM kn WHERE minute(ts) < 30)
SELECT 'model' AS source, count(*) AS rows, rd(avg(ret_60m_bps), 4) AS mean_60m_bps FROM sig
UNION ALL SELECT 'screener', count(*), rd(avg(ret_60m_bps), 4) FROM ea WHERE k <= (SELECT floor(count(*) * 0.01) FROM kn)""")
def screener_baseline(spark, sf):
    b = rounded(forward_bars(spark, sf), "volume_burst", places=9)
    return rounded(S.screener_baseline(b, fraction=0.01), "mean_60m_bps", places=4)


# --------------------------------------------------------------------------- splits and metrics

@query("fold_md5", f"""WITH {SQL_BARS}, h AS (SELECT symbol, md5(upper(symbol)) AS d FROM bars GROUP BY 1)
SELECT symbol, CAST(({' + '.join(f"CAST(('0x' || substr(d, {k}, 8)) AS BIGINT)" for k in (1, 9, 17, 25))}) % 5 AS INTEGER) AS fold FROM h""")
def fold_md5(spark, sf):
    return P.hash_folds(scored_bars(spark, sf).select("symbol").distinct())


@query("fold_blocks", f"""WITH {SQL_BARS}, d AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS no, ntile(5) OVER (ORDER BY trade_date) AS b FROM (SELECT DISTINCT trade_date FROM bars)),
 e AS (SELECT b AS fold, min(no) AS lo, max(no) AS hi FROM d GROUP BY 1)
SELECT fold, trade_date, CASE WHEN no BETWEEN lo AND hi THEN 'val' WHEN no = lo - 1 OR no = hi + 1 THEN 'purged' ELSE 'train' END AS role FROM d CROSS JOIN e""")
def fold_blocks(spark, sf):
    return P.block_folds(scored_bars(spark, sf))


@query("walk_forward_split", f"""WITH {SQL_BARS}, d AS (SELECT trade_date, min(ts) AS t0, row_number() OVER (ORDER BY trade_date) AS no FROM bars GROUP BY 1),
 f AS (SELECT no - 5 AS fold, no AS vno, t0 FROM d WHERE no > 5)
SELECT fold, 'val' AS role, count(*) AS rows FROM f JOIN d ON d.no = f.vno JOIN bars USING (trade_date) GROUP BY 1
UNION ALL SELECT fold, 'train', count(*) FROM f JOIN d ON d.no < f.vno JOIN bars ON bars.trade_date = d.trade_date AND bars.ts < f.t0 - INTERVAL '60 minutes' GROUP BY 1""")
def walk_forward_split(spark, sf):
    b = scored_bars(spark, sf)
    return P.split_sizes(b, P.walk_forward_folds(b), 60)


@query("fold_map")
def fold_map(spark, sf):
    """Seeded folds with their checks: hash order has no counterpart in the check engine."""
    b = scored_bars(spark, sf)
    return P.check_folds(P.mapped_folds(b, P.seeded_folds(b)))


# A stored map knows the symbols with an even number; the others fall to the digest.
_MAPPED = f"{_SYM} % 2 = 0"
_SQL_MD5 = " + ".join(f"CAST(('0x' || substr(md5(upper(symbol)), {k}, 8)) AS BIGINT)" for k in (1, 9, 17, 25))
_SQL_FOLD = f"CASE WHEN {_MAPPED} THEN {_SYM} // 2 % 5 ELSE ({_SQL_MD5}) % 5 END"


def _stored_folds(spark, sf):
    """The map of even symbols, written as JSON and read again."""
    known = scored_bars(spark, sf).select("symbol").distinct().where(_MAPPED).withColumn("fold", F.expr(f"CAST({_SYM} div 2 % 5 AS INT)"))
    path = f"{checkpoint_dir(spark)}/folds/{uuid.uuid4().hex}"
    P.save_fold_map(known, path)
    return P.load_fold_map(spark, path)


@query("mapped_folds", f"WITH {SQL_BARS} SELECT symbol, CAST({_SQL_FOLD} AS INTEGER) AS fold, count(*) AS rows FROM bars GROUP BY 1")
def mapped_folds(spark, sf):
    assigned = P.mapped_folds(scored_bars(spark, sf), _stored_folds(spark, sf))
    return assigned.groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("prediction_audit", f"""WITH {SQL_BARS}, {SQL_LABELS}, ok AS (SELECT * FROM labelled WHERE label_8m_1pct IS NOT NULL AND ltp IS NOT NULL AND delta_1m IS NOT NULL AND volume_1m IS NOT NULL AND roc_3 IS NOT NULL)
SELECT ts, symbol, upper(symbol) || '_' || strftime(trade_date, '%d_%b_%y') AS slug, CAST({_SQL_FOLD} AS INTEGER) AS fold, rd(ltp, 6) AS ltp,
  rd((ltp - lag(ltp, 9) OVER w) / lag(ltp, 9) OVER w * 100, 6) AS roc_9pct, label_8m_1pct, rd(return_8m, 6) AS return_8m, TRUE AS lr_said, TRUE AS rf_said
FROM ok WINDOW w AS ({_D})""")
def prediction_audit(spark, sf):
    """The exported table read back; the predictions themselves have no counterpart outside Spark, but each bar has both."""
    out = prediction_audit_table(_model_bars(spark, sf), _stored_folds(spark, sf), {"lr": O.logistic(max_iter=10), "rf": O.forest(5, 4, 5, every=2)},
                                 _LABEL, "return_8m", ["delta_1m", "volume_1m", "roc_3"])
    path = f"{checkpoint_dir(spark)}/audit/{uuid.uuid4().hex}"
    write_results(out, path, "csv")
    said = lambda m: F.col(f"pred_{m}").isin(*O.CLASSES).alias(f"{m}_said")
    back = spark.read.option("header", "true").schema(out.schema).csv(path)
    return naive_ts(rounded(back.select("ts", "symbol", "slug", "fold", "ltp", "roc_9pct", _LABEL, "return_8m", said("lr"), said("rf")), "ltp", "roc_9pct", "return_8m"))


_SQL_PL = f"{SQL_LABELS}, lp AS (SELECT *, {_PRED.format(t=0.6)} AS pred, label_8m_1pct AS y FROM labelled WHERE label_8m_1pct IS NOT NULL)"


def scored_labels(spark, sf):
    from tidemark.operators.alerts import classify
    return labelled_bars(spark, sf).withColumn("pred", classify(0.6)).where("label_8m_1pct IS NOT NULL")


@query("confusion", f"WITH {SQL_BARS}, {_SQL_PL} SELECT y AS truth, pred, count(*) AS n FROM lp GROUP BY ALL")
def confusion(spark, sf):
    return X.confusion(scored_labels(spark, sf), "label_8m_1pct", "pred")


_SQL_MCC = """cf AS (SELECT trade_date, y, pred, count(*) AS n FROM lp GROUP BY ALL),
 tk AS (SELECT trade_date, y AS l, sum(n) AS t FROM cf GROUP BY ALL), pk AS (SELECT trade_date, pred AS l, sum(n) AS p FROM cf GROUP BY ALL),
 sm AS (SELECT trade_date, sum(n) AS s, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS c FROM cf GROUP BY 1),
 pp AS (SELECT trade_date, sum(p * p) AS pp FROM pk GROUP BY 1), tt AS (SELECT trade_date, sum(t * t) AS tt FROM tk GROUP BY 1),
 pt AS (SELECT trade_date, sum(p * t) AS pt FROM pk JOIN tk USING (trade_date, l) GROUP BY 1),
 mc AS (SELECT trade_date, CAST(s AS BIGINT) AS rows, CASE WHEN sqrt(CAST(s * s - pp AS DOUBLE) * CAST(s * s - tt AS DOUBLE)) > 0
   THEN CAST(c * s - coalesce(pt, 0) AS DOUBLE) / sqrt(CAST(s * s - pp AS DOUBLE) * CAST(s * s - tt AS DOUBLE)) ELSE 0.0 END AS mcc
   FROM sm JOIN pp USING (trade_date) JOIN tt USING (trade_date) LEFT JOIN pt USING (trade_date))"""


@query("confusion_mcc", f"WITH {SQL_BARS}, {_SQL_PL}, {_SQL_MCC} SELECT trade_date, rows, rd(mcc, 6) AS mcc FROM mc")
def confusion_mcc(spark, sf):
    return rounded(X.mcc(scored_labels(spark, sf), "label_8m_1pct", "pred", ["trade_date"]), "mcc")


@query("fold_summary", f"WITH {SQL_BARS}, {_SQL_PL}, {_SQL_MCC} SELECT count(*) AS folds, rd(avg(mcc), 6) AS mcc_mean, rd(stddev_pop(mcc), 6) AS mcc_std FROM mc")
def fold_summary(spark, sf):
    per_day = X.mcc(scored_labels(spark, sf), "label_8m_1pct", "pred", ["trade_date"])
    return rounded(X.fold_summary(per_day, "mcc"), "mcc_mean", "mcc_std")


@query("class_report", f"""WITH {SQL_BARS}, {_SQL_PL}, k AS (SELECT unnest(['LONG', 'SHORT', 'NO_TRADE']) AS label),
 c AS (SELECT label, (SELECT count(*) FROM lp WHERE y = label) AS t, (SELECT count(*) FROM lp WHERE pred = label) AS p, (SELECT count(*) FROM lp WHERE y = label AND pred = label) AS c FROM k),
 r AS (SELECT label, CASE WHEN p > 0 THEN c / p ELSE 0.0 END AS pr, CASE WHEN t > 0 THEN c / t ELSE 0.0 END AS re, t FROM c WHERE t + p > 0)
SELECT label, rd(pr, 6) AS precision, rd(re, 6) AS recall, rd(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1, t AS support FROM r""")
def class_report(spark, sf):
    return rounded(X.class_report(scored_labels(spark, sf), "label_8m_1pct", "pred"), "precision", "recall", "f1")


def _sql_ap(by):
    b, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    g = f" GROUP BY {by}" if by else ""
    return f"""SELECT {b}CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS positives, rd(coalesce(sum(pos / nullif(tp, 0) * hp / hn), 0.0), 6) AS average_precision FROM (
  SELECT *, sum(pos) OVER ({p}ORDER BY prob_long DESC) AS hp, sum(n) OVER ({p}ORDER BY prob_long DESC) AS hn, sum(pos) OVER ({p.strip()}) AS tp FROM (
    SELECT {b}prob_long, count(*) AS n, count(*) FILTER (WHERE y = 'LONG') AS pos FROM lp GROUP BY ALL)){g}"""


@query("average_precision", f"WITH {SQL_BARS}, {_SQL_PL} {_sql_ap('')}")
def average_precision(spark, sf):
    return rounded(X.average_precision(scored_labels(spark, sf), "prob_long", F.col("label_8m_1pct") == "LONG"), "average_precision")


@query("average_precision_by_day", f"WITH {SQL_BARS}, {_SQL_PL} {_sql_ap('trade_date')}")
def average_precision_by_day(spark, sf):
    return rounded(X.average_precision(scored_labels(spark, sf), "prob_long", F.col("label_8m_1pct") == "LONG", ["trade_date"]), "average_precision")


@query("exact_quantiles", f"""WITH {SQL_BARS} SELECT symbol, count(*) AS n, {', '.join(f'rd(quantile_cont(volume_1m, {p}), 6) AS q{i}' for i, p in enumerate((0.1, 0.5, 0.99)))} FROM bars GROUP BY 1""")
def quantiles(spark, sf):
    out = exact_quantiles(scored_bars(spark, sf), "volume_1m", [0.1, 0.5, 0.99], ["symbol"])
    return out.select("symbol", "n", *[rd(F.col("q")[i], 6).alias(f"q{i}") for i in range(3)])


@query("robust_scale", f"""WITH {SQL_BARS}, q AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS i_{c}" for c in ('delta_1m', 'roc_3'))} FROM bars)
SELECT symbol, trade_date, ts, {', '.join(f"rd(({c} - m_{c}) / CASE WHEN i_{c} = 0 THEN 1.0 ELSE i_{c} END, 6) AS {c}_scaled" for c in ('delta_1m', 'roc_3'))} FROM bars, q""")
def robust_scale(spark, sf):
    out = O.robust_scale(scored_bars(spark, sf), ["delta_1m", "roc_3"])
    return naive_ts(rounded(out.select(*_HEAD, "delta_1m_scaled", "roc_3_scaled"), "delta_1m_scaled", "roc_3_scaled"))


# --------------------------------------------------------------------------- models (no exact counterpart outside Spark)

_INPUTS = ["delta_1m", "volume_burst", "aggressor_ratio", "trade_count_burst", "roc_3"]
_LABEL = "label_8m_1pct"


def _model_bars(spark, sf):
    return stage(labelled_bars(spark, sf).drop("prob_long", "prob_short", "prob_no_trade"))


def _oof(make_fit):
    def run(spark, sf):
        b = _model_bars(spark, sf)
        scored = O.out_of_fold(b, P.block_folds(b, 3), make_fit(), _LABEL, _INPUTS, None)
        return naive_ts(scored.select("fold", *_HEAD, _LABEL, *[rd(p, 6).alias(p) for p in O.PROBS]))
    return run


query("oof_lr")(_oof(lambda: O.logistic(max_iter=30)))
query("oof_rf")(_oof(lambda: O.forest(20, 6, 5, every=2)))
query("oof_gbt")(_oof(lambda: O.boosted(5, 3)))


@query("oof_evaluation")
def oof_evaluation(spark, sf):
    return O.evaluate(_oof(lambda: O.logistic(max_iter=30))(spark, sf), _LABEL, ["fold"])


@query("shuffle_control")
def shuffle_control(spark, sf):
    b = _model_bars(spark, sf)
    moved = O.shuffled(b.where(F.col(_LABEL).isNotNull()).withColumn("_g", F.lit(0)), _LABEL, ["_g"]).drop("_g")
    scored = O.out_of_fold(moved, P.block_folds(moved, 3), O.logistic(max_iter=20), _LABEL, _INPUTS, None)
    return O.evaluate(scored, _LABEL, ["fold"])


def _per_fold(run):
    def query_(spark, sf):
        b = _model_bars(spark, sf)
        return O.per_fold(b, P.block_folds(b, 3), run, _LABEL, None)
    return query_


query("importance")(_per_fold(lambda train, val: O.tree_importance(train, _LABEL, _INPUTS)))
query("coefficients")(_per_fold(lambda train, val: O.coefficients(train, _LABEL, _INPUTS)))


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Every fold, and their mean per feature."""
    def run(train, val):
        score = O.logistic(max_iter=20)(O.training_rows(train, _LABEL, _INPUTS), _INPUTS)
        return O.permutation_importance(score, val.where(F.col(_LABEL).isNotNull()), _LABEL, _INPUTS)
    return O.fold_means(_per_fold(run)(spark, sf), ["feature"], ["mcc", "mcc_shuffled", "importance"])


@query("boosting_rounds", f"""SELECT CAST(fold AS BIGINT) AS fold, class, 25 AS max_rounds, TRUE AS stopped_early
FROM range(1, 4) AS f(fold) CROSS JOIN (SELECT unnest(['LONG', 'SHORT', 'NO_TRADE']) AS class)""")
def boosting_rounds(spark, sf):
    """Labels that are permuted hold nothing to learn: held-back days stop every fold and class before the last round."""
    bars = _model_bars(spark, sf)
    b = bars.where(F.col(_LABEL).isNotNull())
    noise = stage(O.shuffled(b.withColumn("_g", F.lit(0)), _LABEL, ["_g"]).drop("_g"))
    used = O.rounds_used(noise, P.block_folds(bars, 3), _LABEL, _INPUTS, None, rounds=25, depth=3, step=0.3, hold_back=0.25)
    return used.select(F.col("fold").cast("bigint").alias("fold"), "class", "max_rounds", (F.col("rounds") < F.col("max_rounds")).alias("stopped_early"))


#: Of the calendar, the days that come after the stored table; and a symbol that it lacks on its last day.
_NEW_DAYS, _LATE_SYMBOL = 3, "S0"
_SQL_OLD = f"""days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date DESC) AS back FROM (SELECT DISTINCT trade_date FROM bars)),
 kept AS (SELECT bars.*, back > {_NEW_DAYS} AND NOT (back = {_NEW_DAYS} + 1 AND symbol = '{_LATE_SYMBOL}') AS old FROM bars JOIN days USING (trade_date))"""


def _stored_scores(spark, sf):
    """All but the last days, scored out of fold and stored."""
    from pyspark.sql import Window

    b = _model_bars(spark, sf)
    back = b.select("trade_date").distinct().withColumn("back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("trade_date"))))
    marked = b.join(F.broadcast(back), "trade_date")  # one row per day of the calendar
    old = stage(marked.where((F.col("back") > _NEW_DAYS) & ~((F.col("back") == _NEW_DAYS + 1) & (F.col("symbol") == _LATE_SYMBOL))).drop("back"))
    path = f"{checkpoint_dir(spark)}/scores/{uuid.uuid4().hex}"
    V.save_scores(O.out_of_fold(old, P.block_folds(old, 2), O.logistic(max_iter=10), _LABEL, _INPUTS, None), path, "first")
    return b, path


def _same_rows(before, after):
    """How many rows of each day are unchanged."""
    cols = [F.col(c) for c in before.columns]
    return before.withColumn("_h", F.xxhash64(*cols)).join(after.select(*before.columns).withColumn("_h", F.xxhash64(*cols)).select("_h", *_HEAD), ["_h", *_HEAD])


@query("oof_extend", f"""WITH {SQL_BARS}, {_SQL_OLD}
SELECT trade_date, count(*) AS rows, count(*) FILTER (WHERE NOT old) AS new_rows, count(*) FILTER (WHERE old) AS unchanged_rows, count(*) AS sums_to_one
FROM kept GROUP BY 1""")
def oof_extend(spark, sf):
    """New days, and a symbol that a stored day lacked, are appended; the stored rows stay as they are."""
    b, path = _stored_scores(spark, sf)
    before = stage(V.scores(spark, path))
    V.extend_scores(b, path, O.logistic(max_iter=10), _LABEL, "second", _INPUTS, 0, least_classes=0)
    after = V.scores(spark, path)
    total = sum((F.col(p) for p in O.PROBS), F.lit(0.0))
    rows = after.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(V.VERSION) == "second").alias("new_rows"), F.count_if(F.abs(total - 1) < 1e-6).alias("sums_to_one"))
    same = _same_rows(before, after).groupBy("trade_date").agg(F.count(F.lit(1)).alias("unchanged_rows"))
    return rows.join(same, "trade_date", "left").withColumn("unchanged_rows", F.coalesce("unchanged_rows", F.lit(0).cast("bigint")))


@query("oof_refresh", f"""WITH {SQL_BARS}, {_SQL_OLD}, last AS (SELECT max(trade_date) AS day FROM kept WHERE old)
SELECT trade_date, count(*) AS rows, CASE WHEN trade_date = day THEN 'second' ELSE 'first' END AS model_version,
  CASE WHEN trade_date = day THEN count(*) ELSE 0 END AS replaced_rows, CASE WHEN trade_date = day THEN 0 ELSE count(*) END AS unchanged_rows,
  count(*) AS same_bars, CAST(0 AS BIGINT) AS replaced_again FROM kept CROSS JOIN last WHERE old GROUP BY trade_date, day""")
def oof_refresh(spark, sf):
    """The last stored day is scored by a newer model; a second call has nothing to do."""
    b, path = _stored_scores(spark, sf)
    before = stage(V.scores(spark, path))
    last = before.agg(F.max("trade_date")).first()[0]
    newer = O.forest(5, 3, 5, every=1)(O.training_rows(b.where(F.col("trade_date") < F.lit(last)), _LABEL, _INPUTS), _INPUTS)
    done = V.refresh_scores(spark, path, newer, "second", str(last))
    again = V.refresh_scores(spark, path, newer, "second", str(last))
    after = V.scores(spark, path)
    rows = after.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.max(V.VERSION).alias("model_version"))
    count = lambda df, name: df.groupBy("trade_date").agg(F.count(F.lit(1)).alias(name))
    bars_only = [c for c in before.columns if c not in (*O.PROBS, V.VERSION)]
    out = rows.join(done.withColumnRenamed("rows", "replaced_rows"), "trade_date", "left").join(again.withColumnRenamed("rows", "replaced_again"), "trade_date", "left")
    out = out.join(count(_same_rows(before, after), "unchanged_rows"), "trade_date", "left")
    out = out.join(count(_same_rows(before.select(bars_only), after), "same_bars"), "trade_date", "left")
    return out.na.fill(0)


# --------------------------------------------------------------------------- comparison and audit

@query("table_diff", f"""WITH {SQL_BARS}, b AS (SELECT symbol, ts, volume_1m, CASE WHEN volume_1m > 100 THEN close_price + 1 ELSE close_price END AS close_price FROM bars WHERE delta_1m <= 90),
 j AS (SELECT a.symbol || '|' || strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS key, b.symbol IS NOT NULL AS m, a.volume_1m IS DISTINCT FROM b.volume_1m AS v, a.close_price IS DISTINCT FROM b.close_price AS c
  FROM bars a LEFT JOIN b ON a.symbol = b.symbol AND a.ts = b.ts),
 l AS (SELECT '<rows>' AS "column", key, TRUE AS cmp, NOT m AS bad FROM j UNION ALL SELECT 'volume_1m', key, m, m AND v FROM j UNION ALL SELECT 'close_price', key, m, m AND c FROM j)
SELECT "column", count(*) FILTER (WHERE cmp) AS rows, count(*) FILTER (WHERE bad) AS mismatches, rd(count(*) FILTER (WHERE bad) * 100.0 / count(*) FILTER (WHERE cmp), 6) AS pct,
  coalesce(array_to_string((list(key ORDER BY key) FILTER (WHERE bad))[1:5], ';'), '') AS examples FROM l GROUP BY 1""")
def table_diff(spark, sf):
    a = scored_bars(spark, sf).select("symbol", "ts", "volume_1m", "close_price", "delta_1m")
    b = a.where("delta_1m <= 90").withColumn("close_price", F.when(F.col("volume_1m") > 100, F.col("close_price") + 1).otherwise(F.col("close_price")))
    return rounded(C.table_diff(a.drop("delta_1m"), b.drop("delta_1m"), ["symbol", "ts"]), "pct")


@query("bar_reconcile", f"""WITH {SQL_BARS},
 b AS (SELECT symbol, ts, volume_1m + CASE WHEN volume_1m > 120 THEN 9 ELSE 0 END AS volume_1m, trade_count_1m FROM bars),
 l AS (SELECT 'volume_1m' AS field, abs(a.volume_1m - b.volume_1m) AS e, greatest(b.volume_1m, 1) AS d FROM bars a JOIN b USING (symbol, ts)
   UNION ALL SELECT 'trade_count_1m', abs(a.trade_count_1m - b.trade_count_1m), greatest(b.trade_count_1m, 1) FROM bars a JOIN b USING (symbol, ts))
SELECT field, count(*) AS bars, CAST(max(e) AS DOUBLE) AS max_abs_error, rd(max(e * 100.0 / d), 6) AS max_pct_error, count(*) FILTER (WHERE e * 100.0 / d > 5) AS bars_over_limit FROM l GROUP BY 1""")
def bar_reconcile(spark, sf):
    live = scored_bars(spark, sf).select("symbol", "ts", "volume_1m", "trade_count_1m")
    batch = live.withColumn("volume_1m", F.col("volume_1m") + F.when(F.col("volume_1m") > 120, 9).otherwise(0))
    return rounded(C.bar_reconcile(live, batch, ["volume_1m", "trade_count_1m"]), "max_pct_error")


_SQL_TARGET = """tg AS (SELECT trade_date, symbol, CASE WHEN c > o THEN 'LONG' ELSE 'SHORT' END AS side FROM (
  SELECT trade_date, symbol, arg_min(open_price, ts) AS o, arg_max(close_price, ts) AS c, max(high_price) AS h, min(low_price) AS l FROM bars GROUP BY ALL) WHERE (h - l) / l > 0.025
  UNION ALL SELECT DISTINCT trade_date, 'X' || symbol, 'LONG' FROM bars WHERE prob_long > 0.98)"""


@query("audit_list_join", f"""WITH {SQL_BARS}, {_SQL_TARGET}, p AS (SELECT *, {_PRED.format(t=_THETA)} AS pred, {sql_clock()} AS clock FROM bars),
 g AS (SELECT trade_date, symbol, count(*) FILTER (WHERE pred = 'LONG') AS long_alerts, count(*) FILTER (WHERE pred = 'SHORT') AS short_alerts,
  list(clock ORDER BY ts) FILTER (WHERE pred = 'LONG') AS l, list(clock ORDER BY ts) FILTER (WHERE pred = 'SHORT') AS s FROM p GROUP BY ALL)
SELECT trade_date, symbol, side, g.long_alerts IS NULL AS missing, coalesce(long_alerts, 0) AS long_alerts, coalesce(short_alerts, 0) AS short_alerts,
  coalesce(array_to_string(l[1:5], ', ') || CASE WHEN long_alerts > 5 THEN '...' ELSE '' END, 'None') AS long_times,
  coalesce(array_to_string(s[1:5], ', ') || CASE WHEN short_alerts > 5 THEN '...' ELSE '' END, 'None') AS short_times
FROM tg LEFT JOIN g USING (trade_date, symbol)""")
def audit_list_join(spark, sf):
    from tidemark.functions.clock import micros
    b = predicted(spark, sf)
    day = b.groupBy("trade_date", "symbol").agg(
        F.min_by("open_price", micros("ts")).alias("o"), F.max_by("close_price", micros("ts")).alias("c"),
        F.max("high_price").alias("h"), F.min("low_price").alias("l"))
    side = F.when(F.col("c") > F.col("o"), "LONG").otherwise("SHORT")
    targets = day.where("(h - l) / l > 0.025").select("trade_date", "symbol", side.alias("side"))
    absent = b.where("prob_long > 0.98").select("trade_date", F.concat(F.lit("X"), "symbol").alias("symbol"), F.lit("LONG").alias("side")).distinct()
    return C.audit_list(b, targets.unionByName(absent))

