"""Queries over bars: features, labels, alignment, the full matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.inputs import (
    Registry, BAR, BOOK_FEED, SQL_BAR, SQL_BARS, SQL_TICKS, TICK_FEED, book, naive_ts, rd, rounded, scored_bars, sql_book,
    sql_clock, ticks,
)
from tidemark.catalog.raw import SQL_BOOK_BARS, SQL_LARGE, SQL_TRADES, sql_trade_bars
from tidemark.operators import align as A
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators import labels as L
from tidemark.operators.clean import extract_trades
from tidemark.operators.trades import infer_trades
from tidemark.plans.matrix import feature_matrix as build_matrix

query = Registry()
QUERIES, SQL = query.queries, query.sql


_D = "PARTITION BY symbol, trade_date ORDER BY ts"
_HEAD = ["symbol", "trade_date", "ts"]

# merged bars of the book view, large trades flagged by the running median
SQL_MERGED = f"""{SQL_TRADES}, {SQL_LARGE}, {SQL_BOOK_BARS}, {sql_trade_bars('flagged', 'is_large')},
merged AS (SELECT b.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in B.TRADE_SUMS)}, coalesce(vwap_1m, 0.0) AS vwap_1m
  FROM book_bars b LEFT JOIN trade_bars USING (symbol, trade_date, ts))"""

SQL_DEPTH = f"""depth AS (SELECT *,
  CASE WHEN total_bid_qty + total_ask_qty <> 0 THEN (total_bid_qty - total_ask_qty) / (total_bid_qty + total_ask_qty) ELSE 0.0 END AS imbalance_top5,
  ask1 - bid1 AS spread, coalesce(total_bid_qty - lag(total_bid_qty) OVER w, 0.0) AS depth_drop_bid,
  coalesce(total_ask_qty - lag(total_ask_qty) OVER w, 0.0) AS depth_drop_ask FROM {{src}} WINDOW w AS ({_D}))"""


def _sql_features(src: str) -> str:
    """Every feature, step by step, from merged bars with depth columns."""
    return f"""f1 AS (SELECT *,
  buy_vol_1m - sell_vol_1m AS delta_1m,
  CAST(sum(buy_vol_1m) OVER w5 - sum(sell_vol_1m) OVER w5 AS BIGINT) AS delta_5m,
  CASE WHEN avg(volume_1m) OVER w20 > 0 THEN volume_1m / avg(volume_1m) OVER w20 ELSE 1.0 END AS volume_burst,
  CASE WHEN volume_1m > 0 THEN buy_vol_1m / volume_1m ELSE 0.5 END AS aggressor_ratio,
  CASE WHEN avg(trade_count_1m) OVER w20 > 0 THEN trade_count_1m / avg(trade_count_1m) OVER w20 ELSE 1.0 END AS trade_count_burst,
  CASE WHEN trade_count_1m > 0 THEN large_trade_count_1m / trade_count_1m ELSE 0.0 END AS large_trade_ratio,
  CASE WHEN vwap_1m > 0 THEN (ltp - vwap_1m) / vwap_1m ELSE 0.0 END AS vwap_distance,
  coalesce(stddev_samp(ltp) OVER w5, 0.0) AS volatility_5m,
  coalesce((ltp - lag(ltp) OVER w) - (lag(ltp) OVER w - lag(ltp, 2) OVER w), 0.0) AS price_acceleration,
  coalesce((ltp - lag(ltp) OVER w) / nullif(lag(ltp) OVER w, 0), 0.0) AS return_1m,
  coalesce((ltp - lag(ltp, 5) OVER w) / nullif(lag(ltp, 5) OVER w, 0), 0.0) AS return_5m,
  sum(volume_1m) OVER w5 AS vol_5m,
  total_bid_qty + total_ask_qty AS shown,
  coalesce(total_bid_qty - lag(total_bid_qty) OVER w, 0.0) + coalesce(total_ask_qty - lag(total_ask_qty) OVER w, 0.0) AS change,
  lag(bid1) OVER w AS p_bid1, lag(total_bid_qty) OVER w AS p_bid_qty
  FROM {src} WINDOW w AS ({_D}), w5 AS ({_D} ROWS 4 PRECEDING), w20 AS ({_D} ROWS 19 PRECEDING)),
f2 AS (SELECT *, delta_1m / (volume_1m + 1e-8) AS delta_1m_ratio, delta_5m / (vol_5m + 1e-8) AS delta_5m_ratio,
  CASE WHEN shown > 0 THEN least(100.0, volume_1m / shown * 100.0) ELSE 0.0 END AS iceberg_score,
  CASE WHEN change > 0 THEN least(1.0, greatest(0.0, greatest(-change, 0.0) - volume_1m) / change) ELSE 0.0 END AS order_cancel_rate,
  CASE WHEN bid1 >= p_bid1 AND p_bid_qty > 0 THEN greatest(0.0, least(1.0, (total_bid_qty - p_bid_qty) / p_bid_qty)) ELSE 0.0 END AS bid_replenishment_rate
  FROM f1),
feats AS (SELECT *, {', '.join(
    f"CASE WHEN delta_{n}_ratio < 0 AND return_{n} > 0 THEN -delta_{n}_ratio * return_{n} ELSE 0.0 END AS absorption_buyer_{n}, "
    f"CASE WHEN delta_{n}_ratio > 0 AND return_{n} < 0 THEN delta_{n}_ratio * -return_{n} ELSE 0.0 END AS absorption_seller_{n}"
    for n in ('1m', '5m'))} FROM f2)"""


_FLOW = ["delta_1m", "delta_5m", "volume_burst", "aggressor_ratio", "trade_count_burst", "large_trade_ratio"]
_PRICE = ["vwap_distance", "volatility_5m", "price_acceleration", "return_1m", "return_5m"]
_DEPTH = ["imbalance_top5", "spread", "depth_drop_bid", "depth_drop_ask"]
_MICRO = ["iceberg_score", "order_cancel_rate", "bid_replenishment_rate"]
_ABSORB = ["delta_1m_ratio", "delta_5m_ratio"] + [f"absorption_{s}_{n}" for s in ("buyer", "seller") for n in ("1m", "5m")]
_ALL = _FLOW + _PRICE + _DEPTH + _MICRO + _ABSORB
_WHOLE = {"delta_1m", "delta_5m"}
_PLACES = 5


def _sql_cols(cols):
    # adding 0.0 turns a rounded negative zero into zero
    return ", ".join(c if c in _WHOLE else f"rd({c}, {_PLACES}) AS {c}" for c in cols)


def _cols(df, cols):
    return naive_ts(df.select(*_HEAD, *[F.col(c) if c in _WHOLE else (rd(c, _PLACES)).alias(c) for c in cols]))


_FEAT_SQL = f"WITH {SQL_MERGED}, {SQL_DEPTH.format(src='merged')}, {_sql_features('depth')} SELECT symbol, trade_date, ts, {{cols}} FROM {{src}}"


def _merged_bars(spark, sf):
    b = book(spark, sf)
    order = ("ts", "seq", "priority", "level_idx", "direction")
    flagged = X.large_trade_flag(infer_trades(b), order=order)
    return B.bars_with_trades(X.depth_features(B.book_bars(b, bar=BAR)), B.trade_bars(flagged, bar=BAR))


@query("feat_trade_flow", _FEAT_SQL.format(cols=_sql_cols(_FLOW), src="feats"))
def feat_trade_flow(spark, sf):
    return _cols(X.trade_flow(_merged_bars(spark, sf)), _FLOW)


@query("feat_price", _FEAT_SQL.format(cols=_sql_cols(_PRICE), src="feats"))
def feat_price(spark, sf):
    return _cols(X.price_features(_merged_bars(spark, sf)), _PRICE)


@query("feat_depth", f"WITH {SQL_BOOK_BARS}, {SQL_DEPTH.format(src='book_bars')} SELECT symbol, trade_date, ts, {_sql_cols(_DEPTH)} FROM depth")
def feat_depth(spark, sf):
    return _cols(X.depth_features(B.book_bars(book(spark, sf), bar=BAR)), _DEPTH)


@query("feat_micro", _FEAT_SQL.format(cols=_sql_cols(_MICRO), src="feats"))
def feat_micro(spark, sf):
    return _cols(X.micro_features(_merged_bars(spark, sf)), _MICRO)


@query("feat_absorption", _FEAT_SQL.format(cols=_sql_cols(_ABSORB), src="feats"))
def feat_absorption(spark, sf):
    return _cols(X.all_features(_merged_bars(spark, sf)), _ABSORB)


@query("quality_gate", _FEAT_SQL.split("SELECT symbol, trade_date, ts, {cols}")[0] + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL) AS nulls, rd(CAST(min({f}) AS DOUBLE), 5) AS actual_min,
  rd(CAST(max({f}) AS DOUBLE), 5) AS actual_max, CAST({lo} AS DOUBLE) AS allowed_min, CAST({hi} AS DOUBLE) AS allowed_max,
  count(*) FILTER (WHERE {f} IS NULL) = 0 AND NOT (min({f}) < {lo}) AND NOT (max({f}) > {hi}) AS passed FROM feats"""
    for f, (lo, hi) in X.FEATURE_RANGES.items()))
def quality_gate(spark, sf):
    gate = X.quality_gate(X.all_features(_merged_bars(spark, sf)))
    return gate.withColumns({c: rd(c, 5) for c in ("actual_min", "actual_max")})


@query("cross_section", f"""WITH {SQL_BOOK_BARS}, {SQL_DEPTH.format(src='book_bars')},
 s AS (SELECT ts, avg(imbalance_top5) AS m, stddev_samp(imbalance_top5) AS d FROM depth GROUP BY 1)
SELECT symbol, trade_date, ts, rd(CASE WHEN d > 0 THEN (imbalance_top5 - m) / d ELSE 0.0 END, 5) AS imbalance_top5_z
FROM depth JOIN s USING (ts)""")
def cross_section(spark, sf):
    bars = X.depth_features(B.book_bars(book(spark, sf), bar=BAR))
    return _cols(X.cross_section(bars, ["imbalance_top5"]), ["imbalance_top5_z"])


# --------------------------------------------------------------------------- labels

_H, _T = (4, 8, 16), (0.01, 0.03)
_LABELS = [L.label_name(h, t) for h in _H for t in _T]
SQL_LABELS = f"""labelled AS (SELECT *, {', '.join(
    f"CASE WHEN return_{h}m IS NULL THEN NULL WHEN return_{h}m <= -{t} THEN 'SHORT' WHEN return_{h}m >= {t} THEN 'LONG' ELSE 'NO_TRADE' END AS {L.label_name(h, t)}"
    for h in _H for t in _T)}
  FROM (SELECT *, {', '.join(f'(lead(ltp, {h}) OVER w - ltp) / nullif(ltp, 0) AS return_{h}m' for h in _H)} FROM bars WINDOW w AS ({_D})))"""


def labelled_bars(spark, sf):
    return L.label_matrix(scored_bars(spark, sf), _H, _T)


@query("forward_return", f"WITH {SQL_BARS}, {SQL_LABELS} SELECT symbol, trade_date, ts, {', '.join(f'rd(return_{h}m, 8) AS return_{h}m' for h in _H)} FROM labelled")
def forward_return(spark, sf):
    b = scored_bars(spark, sf)
    return naive_ts(b.select(*_HEAD, *[(rd(L.forward_return(h), 8)).alias(f"return_{h}m") for h in _H]))


@query("label_matrix", f"WITH {SQL_BARS}, {SQL_LABELS} SELECT symbol, trade_date, ts, {', '.join(_LABELS)} FROM labelled")
def label_matrix(spark, sf):
    return naive_ts(labelled_bars(spark, sf).select(*_HEAD, *_LABELS))


@query("label_summary", f"WITH {SQL_BARS}, {SQL_LABELS} " + " UNION ALL ".join(f"""
SELECT CAST({h} AS BIGINT) AS horizon, CAST({t} AS DOUBLE) AS threshold, '{c}' AS label_column, {c} AS label, count(*) AS n,
  (SELECT count(*) FROM labelled) AS total_rows, (SELECT count({c}) FROM labelled) AS available,
  (SELECT count(*) - count({c}) FROM labelled) AS unavailable, rd(count(*) * 100.0 / (SELECT count({c}) FROM labelled), 6) AS pct
FROM labelled WHERE {c} IS NOT NULL GROUP BY {c}""" for h in _H for t in _T for c in [L.label_name(h, t)]))
def label_summary(spark, sf):
    return rounded(L.label_summary(labelled_bars(spark, sf), _H, _T), "pct")


@query("feature_by_label", f"""WITH {SQL_BARS}, {SQL_LABELS}
SELECT label_8m_1pct AS label, count(*) AS n, rd(avg(delta_1m), 6) AS delta_1m, rd(avg(volume_burst), 6) AS volume_burst
FROM labelled WHERE label_8m_1pct IS NOT NULL GROUP BY 1""")
def feature_by_label(spark, sf):
    return rounded(L.feature_by_label(labelled_bars(spark, sf), "label_8m_1pct", ["delta_1m", "volume_burst"]),
                   "delta_1m", "volume_burst")


@query("first_touch_label", f"""WITH {SQL_BARS}, live AS (SELECT * FROM bars WHERE {sql_clock()} < '15:00:00'),
 hit AS (SELECT a.symbol, a.trade_date, a.ts, min(b.ts) FILTER (WHERE b.ltp >= a.ltp * (1 + 0.015)) AS up_ts,
   min(b.ts) FILTER (WHERE b.ltp <= a.ltp * (1 - 0.015)) AS down_ts
  FROM live a LEFT JOIN live b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND b.ts > a.ts GROUP BY ALL)
SELECT symbol, trade_date, ts, CASE WHEN up_ts IS NOT NULL AND (down_ts IS NULL OR up_ts < down_ts) THEN 'LONG'
  WHEN down_ts IS NOT NULL THEN 'SHORT' ELSE 'NO_TRADE' END AS first_touch FROM hit""")
def first_touch_label(spark, sf):
    return naive_ts(L.first_touch_label(scored_bars(spark, sf)).select(*_HEAD, "first_touch"))


# --------------------------------------------------------------------------- alignment

_TOL_S = 1200.0
_SCORES = {"tolerance_ms": _TOL_S * 1000, "min_aqs": 0.5, "min_dcs": 0.4, "min_wvs": 0.4}


def _sql_match(name, left, right):
    """Backward and forward as-of joins, nearer one, earlier on a tie."""
    return f"""{name} AS (
  SELECT l.symbol, l.trade_date, l.ts, l.seq AS row_id,
    CASE WHEN gap <= {int(_TOL_S * 1e6)} THEN mid END AS match_id, CASE WHEN gap <= {int(_TOL_S * 1e6)} THEN mts END AS match_ts,
    CASE WHEN gap <= {int(_TOL_S * 1e6)} THEN gap / 1000.0 END AS distance_ms
  FROM (SELECT l.symbol, l.trade_date, l.ts, l.seq,
      CASE WHEN b.seq IS NOT NULL AND (f.seq IS NULL OR epoch_us(l.ts) - epoch_us(b.ts) <= epoch_us(f.ts) - epoch_us(l.ts)) THEN b.seq ELSE f.seq END AS mid,
      CASE WHEN b.seq IS NOT NULL AND (f.seq IS NULL OR epoch_us(l.ts) - epoch_us(b.ts) <= epoch_us(f.ts) - epoch_us(l.ts)) THEN b.ts ELSE f.ts END AS mts,
      CASE WHEN b.seq IS NOT NULL AND (f.seq IS NULL OR epoch_us(l.ts) - epoch_us(b.ts) <= epoch_us(f.ts) - epoch_us(l.ts))
        THEN epoch_us(l.ts) - epoch_us(b.ts) ELSE epoch_us(f.ts) - epoch_us(l.ts) END AS gap
    FROM {left} l ASOF LEFT JOIN {right} b ON l.symbol = b.symbol AND l.trade_date = b.trade_date AND l.ts >= b.ts
      ASOF LEFT JOIN {right} f ON l.symbol = f.symbol AND l.trade_date = f.trade_date AND l.ts <= f.ts) l)"""


SQL_ALIGN = f"""t AS ({SQL_TICKS}), tk AS (SELECT * FROM t WHERE {TICK_FEED}), bk AS (SELECT * FROM t WHERE {BOOK_FEED}),
{_sql_match('tm', 'tk', 'bk')}, {_sql_match('bm', 'bk', 'tk')},
tw AS (SELECT symbol, trade_date, {SQL_BAR} AS window_start, count(*) AS tick_count, count(match_id) AS tick_matched_count,
  avg(distance_ms) AS ta, max(distance_ms) AS tx FROM tm GROUP BY ALL),
bw AS (SELECT symbol, trade_date, {SQL_BAR} AS window_start, count(*) AS dom_count, count(match_id) AS dom_matched_count,
  avg(distance_ms) AS ba, max(distance_ms) AS bx FROM bm GROUP BY ALL),
w0 AS (SELECT symbol, trade_date, window_start, coalesce(tick_count, 0) AS tick_count, coalesce(tick_matched_count, 0) AS tick_matched_count,
  coalesce(dom_count, 0) AS dom_count, coalesce(dom_matched_count, 0) AS dom_matched_count,
  coalesce((ta + ba) / 2.0, ta, ba) AS avg_alignment_distance_ms, greatest(tx, bx) AS max_alignment_distance_ms
  FROM tw FULL JOIN bw USING (symbol, trade_date, window_start)),
wm AS (SELECT *, tick_count - tick_matched_count AS unmatched_tick_count, dom_count - dom_matched_count AS unmatched_dom_count,
  CASE WHEN tick_count > 0 THEN tick_matched_count / tick_count ELSE 0.0 END AS matched_tick_ratio,
  CASE WHEN dom_count > 0 THEN dom_matched_count / dom_count ELSE 0.0 END AS matched_dom_ratio,
  (tick_count - tick_matched_count + dom_count - dom_matched_count) / (tick_count + dom_count) AS unmatched_ratio FROM w0),
sc0 AS (SELECT *, coalesce(least(avg_alignment_distance_ms / {_SCORES['tolerance_ms']}, 1.0), 1.0) AS normalized_avg_distance FROM wm),
sc1 AS (SELECT *, least(1.0, greatest(0.0, 1.0 - (0.6 * unmatched_ratio + 0.4 * normalized_avg_distance))) AS aqs,
  least(matched_tick_ratio, matched_dom_ratio) AS dcs FROM sc0),
sc AS (SELECT *, least(aqs, dcs) AS wvs,
  tick_count >= 1 AND dom_count >= 1 AND aqs >= 0.5 AND dcs >= 0.4 AND least(aqs, dcs) >= 0.4 AS window_valid,
  concat_ws(';', CASE WHEN tick_count < 1 THEN 'insufficient_tick_events' END, CASE WHEN dom_count < 1 THEN 'insufficient_dom_events' END,
    CASE WHEN aqs < 0.5 THEN 'low_alignment_quality' END, CASE WHEN dcs < 0.4 THEN 'low_data_completeness' END,
    CASE WHEN least(aqs, dcs) < 0.4 THEN 'low_window_validity' END) AS failure_reason FROM sc1),
span AS (SELECT symbol, trade_date, time_bucket(INTERVAL '15 minutes', greatest(a, c)) AS from_ts, time_bucket(INTERVAL '15 minutes', least(b, d)) AS to_ts
  FROM (SELECT symbol, trade_date, min(ts) AS a, max(ts) AS b FROM tk GROUP BY ALL) JOIN
       (SELECT symbol, trade_date, min(ts) AS c, max(ts) AS d FROM bk GROUP BY ALL) USING (symbol, trade_date) WHERE greatest(a, c) <= least(b, d)),
valid AS (SELECT sc.* FROM sc JOIN span USING (symbol, trade_date) WHERE window_valid AND window_start BETWEEN from_ts AND to_ts)"""

_WM = ["tick_count", "dom_count", "tick_matched_count", "dom_matched_count", "unmatched_tick_count", "unmatched_dom_count"]
_WM_D = ["matched_tick_ratio", "matched_dom_ratio", "unmatched_ratio", "avg_alignment_distance_ms", "max_alignment_distance_ms"]
_SC_D = ["normalized_avg_distance", "aqs", "dcs", "wvs"]
_round = lambda cols: ", ".join(f"rd({c}, 4) AS {c}" for c in cols)


def _feeds(spark, sf):
    t = ticks(spark, sf)
    return t.where(TICK_FEED), t.where(BOOK_FEED)


def _aligned(spark, sf):
    tk, bk = _feeds(spark, sf)
    return A.align(tk, bk, _TOL_S, BAR)


@query("asof_nearest", f"WITH {SQL_ALIGN} SELECT * FROM tm")
def asof_nearest(spark, sf):
    tk, bk = _feeds(spark, sf)
    return naive_ts(A.nearest_match(tk, bk, _TOL_S), "match_ts")


@query("align_windows", f"WITH {SQL_ALIGN} SELECT symbol, trade_date, window_start, {', '.join(_WM)}, {_round(_WM_D)} FROM wm")
def align_windows(spark, sf):
    m = _aligned(spark, sf)["window_metrics"]
    return naive_ts(rounded(m, *_WM_D, places=4), "window_start")


@query("align_global", f"""WITH {SQL_ALIGN},
 a AS (SELECT symbol, trade_date, count(*) AS total_tick_count, count(match_id) AS matched_tick_count,
   avg(distance_ms) AS avg_alignment_distance_ms, max(distance_ms) AS max_alignment_distance_ms FROM tm GROUP BY ALL),
 b AS (SELECT symbol, trade_date, count(*) AS total_dom_count, count(match_id) AS matched_dom_count FROM bm GROUP BY ALL),
 g AS (SELECT symbol, trade_date, coalesce(total_tick_count, 0) AS total_tick_count, coalesce(matched_tick_count, 0) AS matched_tick_count,
   coalesce(total_dom_count, 0) AS total_dom_count, coalesce(matched_dom_count, 0) AS matched_dom_count,
   rd(avg_alignment_distance_ms, 4) AS avg_alignment_distance_ms, rd(max_alignment_distance_ms, 4) AS max_alignment_distance_ms
   FROM a FULL JOIN b USING (symbol, trade_date))
SELECT *, total_tick_count - matched_tick_count AS unmatched_tick_count, total_dom_count - matched_dom_count AS unmatched_dom_count,
  rd(CASE WHEN total_tick_count > 0 THEN matched_tick_count / total_tick_count ELSE 0.0 END, 4) AS matched_tick_ratio,
  rd(CASE WHEN total_dom_count > 0 THEN matched_dom_count / total_dom_count ELSE 0.0 END, 4) AS matched_dom_ratio,
  rd((total_tick_count - matched_tick_count + total_dom_count - matched_dom_count) / (total_tick_count + total_dom_count), 4) AS unmatched_ratio FROM g""")
def align_global(spark, sf):
    return rounded(_aligned(spark, sf)["global_metrics"], *_WM_D, places=4)


@query("window_scores", f"""WITH {SQL_ALIGN} SELECT symbol, trade_date, window_start, {_round(_SC_D)}, window_valid, failure_reason FROM sc""")
def window_scores(spark, sf):
    s = A.window_scores(_aligned(spark, sf)["window_metrics"], **_SCORES)
    return naive_ts(rounded(s.select("symbol", "trade_date", "window_start", *_SC_D, "window_valid", "failure_reason"), *_SC_D, places=4), "window_start")


@query("valid_windows", f"WITH {SQL_ALIGN} SELECT symbol, trade_date, window_start, tick_count, dom_count FROM valid")
def valid_windows(spark, sf):
    tk, bk = _feeds(spark, sf)
    v = A.valid_windows(tk, bk, _TOL_S, BAR, **_SCORES)
    return naive_ts(v.select("symbol", "trade_date", "window_start", "tick_count", "dom_count"), "window_start")


# --------------------------------------------------------------------------- the full matrix

_MATRIX_FEATURES = [f for f in _ALL]
SQL_MATRIX = f"""{SQL_ALIGN}, {SQL_MERGED.replace('FROM (' + sql_book() + ') GROUP BY ALL', 'FROM (' + sql_book() + ') WHERE ' + BOOK_FEED + ' GROUP BY ALL').replace(
    'FROM (' + sql_book() + ') WINDOW', 'FROM (' + sql_book() + ') WHERE ' + BOOK_FEED + ' WINDOW')},
{SQL_DEPTH.format(src='merged')},
kept AS (SELECT d.* FROM depth d WHERE (symbol, trade_date, ts) IN (SELECT (symbol, trade_date, window_start) FROM valid)),
{_sql_features('kept')},
traded AS (SELECT DISTINCT symbol, trade_date FROM trades),
full_matrix AS (SELECT symbol, trade_date, ts, {{cols}} FROM feats f LEFT JOIN (SELECT *, TRUE AS has FROM traded) USING (symbol, trade_date))"""
_DEFAULTS = {"delta_1m": 0, "delta_5m": 0, "volume_burst": 0.0, "aggressor_ratio": 0.5, "trade_count_burst": 0.0,
             "large_trade_ratio": 0.0, "iceberg_score": 0.0}
_NULLED = set(_PRICE + _ABSORB)


def _matrix_col(c):
    value = c if c in _WHOLE else f"rd({c}, {_PLACES})"
    if c in _DEFAULTS:
        return f"CAST(CASE WHEN has THEN {value} ELSE {_DEFAULTS[c]} END AS DOUBLE) AS {c}"
    return f"CASE WHEN has THEN {value} END AS {c}" if c in _NULLED else f"{value} AS {c}"


@query("feature_matrix", f"WITH {SQL_MATRIX.format(cols=', '.join(_matrix_col(c) for c in _MATRIX_FEATURES))} SELECT * FROM full_matrix")
def feature_matrix(spark, sf):
    tk = ticks(spark, sf).where(TICK_FEED)
    bk = book(spark, sf).where(BOOK_FEED)
    order = ("ts", "seq", "priority", "level_idx", "direction")
    m = build_matrix(bk, tk, tolerance_s=_TOL_S, bar=BAR, scores=_SCORES, trade_order=order)
    return naive_ts(m.select(*_HEAD, *[(rd(F.col(c).cast("double"), _PLACES)).alias(c) for c in _MATRIX_FEATURES]))


@query("unified_matrix")
def unified_matrix(spark, sf):
    """A tick feed with five levels of depth needs no alignment; executed trades are used as they are."""
    b = book(spark, sf)
    t = ticks(spark, sf)
    m = build_matrix(b, b, extract_trades(t), bar=BAR)
    return naive_ts(m.select(*_HEAD, *[rd(F.col(c).cast("double"), _PLACES).alias(c) for c in _MATRIX_FEATURES]))
