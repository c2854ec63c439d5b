"""Streaming queries: the event table is replayed as a file stream into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.bars_features import _FEAT_SQL
from tidemark.catalog.events import SQL_SEQ
from tidemark.catalog.inputs import BAR, BOOK_TEXT, Registry, naive_ts, rounded, table
from tidemark.models.oof import PROBS, fit_and_save, load_scorer
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.operators.compare import table_diff
from tidemark.operators.schema import MODEL_FEATURES
from tidemark.operators.labels import label_matrix
from tidemark.operators.sequences import pair_table, sequence_trades
from tidemark.operators.trades import infer_trades
from tidemark.session import checkpoint_dir, stage
from tidemark.streaming import live as L

query = Registry()
QUERIES, SQL = query.queries, query.sql

# The book view with a livelier last price, so that momentum rules have something to find.
_OLD, _NEW = "CAST(base AS DOUBLE) / CAST(100 AS DOUBLE) AS ltp", "CAST(100 AS DOUBLE) + value / CAST(100 AS DOUBLE) AS ltp"
LIVE_TEXT = BOOK_TEXT.replace(_OLD, _NEW)
_HEAD = ["symbol", "trade_date", "ts"]
_FLOWS = ["buy_vol_1m", "sell_vol_1m", "volume_1m", "trade_count_1m", "large_trade_count_1m"]
_ORDER = ("ts", "seq", "priority", "level_idx", "direction")


def _stream(spark, sf):
    events = spark.readStream.schema(table(spark, sf, "events").schema).option(
        "pathGlobFilter", "events.parquet").parquet(sf)
    return spark.sql(LIVE_TEXT, events=events)


def _place(spark):
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _bars_table(spark, sf, **rules):
    place, rules = _place(spark), {"session": False, "max_gap_s": None} | rules
    stream = L.live_bars(_stream(spark, sf), BAR, **rules)
    L.run_to_table(stream, f"{place}/closed", f"{place}/bars_ckpt")
    closed = spark.read.parquet(f"{place}/closed").drop("batch_id")
    rest = L.flush(spark, f"{place}/bars_ckpt", BAR, max_gap_s=rules["max_gap_s"])
    closed.unionByName(rest).write.parquet(f"{place}/bars")
    return f"{place}/bars"


_SQL_LIVE = (_FEAT_SQL.split(" SELECT symbol, trade_date, ts, {cols}")[0].replace(_OLD, _NEW)
             .replace("AS open_price, arg_max(ltp, seq) AS close_price",
                      "AS open_price, max(ltp) AS high_price, min(ltp) AS low_price, arg_max(ltp, seq) AS close_price")
             + """, live AS (SELECT *, coalesce((close_price - lag(close_price, 3) OVER w) / lag(close_price, 3) OVER w * 100.0, 0.0) AS roc_3
  FROM feats WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY ts))""")
_PX = ["open_price", "high_price", "low_price", "close_price", "ltp"]


@query("stream_bars", f"{_SQL_LIVE} SELECT symbol, trade_date, ts, {', '.join(f'rd({c}, 5) AS {c}' for c in _PX)} FROM live")
def stream_bars(spark, sf):
    out = spark.read.parquet(_bars_table(spark, sf)).select(*_HEAD, *_PX)
    return naive_ts(rounded(out, *_PX, places=5))


@query("stream_trades", f"{_SQL_LIVE} SELECT symbol, trade_date, ts, {', '.join(_FLOWS)}, rd(vwap_1m, 6) AS vwap_1m FROM live")
def stream_trades(spark, sf):
    out = spark.read.parquet(_bars_table(spark, sf)).select(*_HEAD, *_FLOWS, "vwap_1m")
    return naive_ts(rounded(out, "vwap_1m"))


# The same with the exchange's session only, and no trades from a snapshot after an hour of silence.
_GAP_S = 3600.0
_SESSION = "CAST(ts + INTERVAL '330 minutes' AS TIME) BETWEEN TIME '09:15:00' AND TIME '15:30:00'"
_SQL_RULED = (_SQL_LIVE.replace("FROM events)", f"FROM events WHERE {_SESSION})")
              .replace("lag(ltp) OVER w AS p_ltp", "lag(ltp) OVER w AS p_ltp, lag(ts) OVER w AS p_ts")
              .replace("FROM lagged", f"FROM (SELECT * FROM lagged WHERE ts - p_ts <= INTERVAL '{int(_GAP_S)} seconds')"))


@query("stream_session_bars", f"{_SQL_RULED} SELECT symbol, trade_date, ts, {', '.join(_FLOWS)}, {', '.join(f'rd({c}, 5) AS {c}' for c in [*_PX, 'vwap_1m'])} FROM live")
def stream_session_bars(spark, sf):
    """Session and gap rules on: snapshots outside trading hours are ignored, and one after a long silence trades nothing."""
    out = spark.read.parquet(_bars_table(spark, sf, session=True, max_gap_s=_GAP_S)).select(*_HEAD, *_FLOWS, *_PX, "vwap_1m")
    return naive_ts(rounded(out, *_PX, "vwap_1m", places=5))


@query("stream_features", f"{_SQL_LIVE} SELECT symbol, trade_date, ts, {', '.join(f'rd({c}, 5) AS {c}' for c in [*MODEL_FEATURES, 'roc_3'])} FROM live")
def stream_features(spark, sf):
    out = spark.read.parquet(_bars_table(spark, sf)).select(*_HEAD, *MODEL_FEATURES, "roc_3")
    return naive_ts(rounded(out, *MODEL_FEATURES, "roc_3", places=5))


@query("stream_book_bars", f"""{_SQL_LIVE} SELECT symbol, trade_date, ts, {', '.join(f'rd({c}, 5) AS {c}' for c in _PX)} FROM live
  WHERE ts + INTERVAL '15 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '2 minutes'""")
def stream_book_bars(spark, sf):
    """The JVM-only window aggregate; it emits the bars that the watermark has passed, as append mode does."""
    place = _place(spark)
    L.run_to_table(L.book_bars_stream(_stream(spark, sf), BAR), f"{place}/bars", f"{place}/ckpt")
    return naive_ts(rounded(spark.read.parquet(f"{place}/bars").select(*_HEAD, *_PX), *_PX, places=5))


def _score(bars):
    """A deterministic stand-in for a model: stateless, so it applies to any micro-batch."""
    no = F.expr("CAST(substr(symbol, 2) AS BIGINT) + unix_seconds(CAST(ts AS timestamp)) div 900")
    prob = lambda k: ((no * k) % 100) / F.lit(100.0)
    return bars.withColumns({"prob_long": prob(37), "prob_short": prob(53), "prob_no_trade": prob(71)})


_NO = "(CAST(substr(symbol, 2) AS BIGINT) + epoch_us(ts) // 900000000)"
_SIG_SQL = f"""{_SQL_LIVE}, bars AS (SELECT *, (({_NO} * 37) % 100) / CAST(100 AS DOUBLE) AS prob_long, (({_NO} * 53) % 100) / CAST(100 AS DOUBLE) AS prob_short FROM live),
{SQL_SEQ} SELECT symbol, trade_date, direction, theta_caught_time, mark1_ts AS mark1_time, between_ts AS between_time, entry_time_ist, rd(entry_price, 5) AS entry_price,
  rd(roc_at_entry, 5) AS roc_at_entry, daily_open_passed, bypass_used, rejection_reason FROM strategy WHERE pair = 'L25_S25' AND max_stage = 'TRIGGERED'"""


@query("stream_signals", _SIG_SQL)
def stream_signals(spark, sf):
    bars = _bars_table(spark, sf)
    place = _place(spark)
    feed = _score(spark.readStream.schema(spark.read.parquet(bars).schema).parquet(bars))
    L.run_to_table(L.live_signals(feed), f"{place}/signals", f"{place}/ckpt", transform=L.tradable)
    out = spark.read.parquet(f"{place}/signals")
    return rounded(out.select("symbol", "trade_date", "direction", "theta_caught_time", "mark1_time", "between_time", "entry_time_ist",
                              "entry_price", "roc_at_entry", "daily_open_passed", "bypass_used", "rejection_reason"),
                   "entry_price", "roc_at_entry", places=5)


@query("stream_misses", f"""{_SIG_SQL.partition("SELECT symbol, trade_date, direction, theta_caught_time")[0]}
SELECT direction, rejection_reason, count(*) AS n FROM strategy WHERE pair = 'L25_S25'
  AND (max_stage = 'TRIGGERED' OR trade_date + INTERVAL '25 hours' <= (SELECT max(ts) FROM live) - INTERVAL '2 minutes') GROUP BY ALL""")
def stream_misses(spark, sf):
    """Why directions did not signal, reported when the watermark has passed their day, in one summary with the signals."""
    bars, place = _bars_table(spark, sf), _place(spark)
    feed = _score(spark.readStream.schema(spark.read.parquet(bars).schema).parquet(bars))
    L.run_to_table(L.live_signals(feed, report_misses=True), f"{place}/signals", f"{place}/ckpt")
    return L.state_summary(spark.read.parquet(f"{place}/signals"))


_SIGNAL_FACTS = ["direction", "entry_time_ist", "entry_price", "rejection_reason"]


def model_replay(spark, path, inputs, theta=0.4):
    """Scored bars and signals by a model that is fitted and stored: of the batch, and of the bars replayed as streams."""
    place, bars = _place(spark), spark.read.parquet(path)
    fit_and_save(label_matrix(bars, (4,), (0.01,)), "label_4m_1pct", f"{place}/model", inputs, trees=10)
    feed = lambda: spark.readStream.schema(bars.schema).parquet(path)
    L.run_to_table(L.score_bars(feed(), f"{place}/model", inputs), f"{place}/scores", f"{place}/scores_ckpt")
    L.run_to_table(L.model_signals(feed(), f"{place}/model", inputs, long_theta=theta, short_theta=theta), f"{place}/signals", f"{place}/signals_ckpt")
    batch = stage(load_scorer(f"{place}/model", inputs)(bars))
    trades = sequence_trades(batch, pair_table(spark, [f"L{theta * 100:.0f}_S{theta * 100:.0f}"])).where("max_stage = 'TRIGGERED'")
    return batch, spark.read.parquet(f"{place}/scores"), trades, spark.read.schema(L.SIGNAL_SCHEMA).parquet(f"{place}/signals")


@query("stream_model_scores", f"{_SQL_LIVE} SELECT symbol, trade_date, count(*) AS bars, CAST(0 AS BIGINT) AS other_scores, CAST(0 AS BIGINT) AS other_signals FROM live GROUP BY ALL")
def stream_model_scores(spark, sf):
    """Scores and signals of a replay, by a stored model, against those of the batch: no difference expected."""
    batch, live, trades, signals = model_replay(spark, _bars_table(spark, sf), ["delta_1m", "volume_burst", "aggressor_ratio", "roc_3"])
    probs = [F.round(p, 9).alias(p) for p in PROBS]
    other = lambda a, b: a.exceptAll(b).unionAll(b.exceptAll(a))
    count = lambda df, name: df.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias(name))
    scores = other(batch.select(*_HEAD, *probs), live.select(*_HEAD, *probs))
    entries = other(trades.select("symbol", "trade_date", *_SIGNAL_FACTS), signals.select("symbol", "trade_date", *_SIGNAL_FACTS))
    out = count(live, "bars").join(count(scores, "other_scores"), ["symbol", "trade_date"], "left").join(count(entries, "other_signals"), ["symbol", "trade_date"], "left")
    return out.na.fill(0)


@query("stream_batch_diff", f"""{_SQL_LIVE} SELECT "column", count(*) AS rows, CAST(0 AS BIGINT) AS mismatches
FROM live CROSS JOIN (SELECT unnest({['<rows>', *_PX, *_FLOWS]}) AS "column") GROUP BY 1""")
def stream_batch_diff(spark, sf):
    """Replay against batch: no difference expected."""
    live = spark.read.parquet(_bars_table(spark, sf))
    snapshots = spark.sql(LIVE_TEXT, events=table(spark, sf, "events"))
    flagged = X.large_trade_flag(infer_trades(snapshots), order=_ORDER)
    batch = B.bars_with_trades(B.enrich_with_ohlc(B.book_bars(snapshots, bar=BAR), B.ohlc_bars(snapshots, bar=BAR)),
                               B.trade_bars(flagged, bar=BAR))
    cols = [*_HEAD, *_PX, *_FLOWS]
    return table_diff(live.select(*cols), batch.select(*cols), _HEAD, rtol=1e-9).select("column", "rows", "mismatches")


