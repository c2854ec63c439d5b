"""Stored scores, early stops, live scoring, counted writes, and the linear forms of momentum, paths, controls and touches."""

import time
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import streams
from tidemark.models import audit, store
from tidemark.models import oof as O
from tidemark.models import splits as P
from tidemark.operators import clean as C
from tidemark.operators import labels as L
from tidemark.operators import paths as H
from tidemark.operators import ranks as R
from tidemark.operators import sequences as Q
from tidemark.operators import stats as S
from tidemark.sources import files, sinks
from tidemark.streaming import live

T0 = datetime(2026, 5, 29, 3, 45)
INPUTS = ["a", "b"]


def bars_of(spark, days=6, symbols=("S0", "S1", "S2"), n=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for s in symbols:
            for i in range(n):
                a = float(rng.normal())
                rows.append((s, date(2026, 5, 1) + timedelta(days=d), T0 + timedelta(days=d, minutes=i), a, float(rng.normal()),
                             "LONG" if a > 0.5 else "SHORT" if a < -0.5 else "NO_TRADE", 100 + a))
    return spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp, a double, b double, label string, ltp double")


# --------------------------------------------------------------------------- stored scores

def test_extend_and_refresh(spark, tmp_path):
    path, bars = str(tmp_path / "scores"), bars_of(spark)
    last = date(2026, 5, 6)
    old = bars.where((F.col("trade_date") < F.lit(last)) & ~((F.col("trade_date") == F.lit(date(2026, 5, 5))) & (F.col("symbol") == "S2")))
    fit = O.logistic(max_iter=5)
    store.save_scores(O.out_of_fold(old, P.block_folds(old, 2), fit, "label", INPUTS, None), path, "one")
    before = store.scores(spark, path).toPandas()
    came = store.extend_scores(bars.withColumn("late", F.lit(7)), path, fit, "label", "two", INPUTS, 0).collect()
    assert {(r.trade_date, r.rows) for r in came} == {(date(2026, 5, 5), 20), (last, 60)}
    after = store.scores(spark, path)
    assert after.count() == 360 and after.where("late IS NULL").count() == 280  # aligned: older rows lack the new column
    same = after.where(F.col(store.VERSION) == "one").select(*before.columns).toPandas()
    key = ["symbol", "ts"]
    pd.testing.assert_frame_equal(same.sort_values(key, ignore_index=True), before.sort_values(key, ignore_index=True))
    assert store.extend_scores(bars, path, fit, "label", "three", INPUTS, 0).count() == 0
    # a newer model for the last two days; then for the rest; then there is nothing left
    scorer = fit(O.training_rows(bars, "label", INPUTS), INPUTS)
    days = lambda since=None: {(r.trade_date, r.rows) for r in store.refresh_scores(spark, path, scorer, "new", since).collect()}
    assert days("2026-05-05") == {(date(2026, 5, 5), 60), (last, 60)}
    assert len(days()) == 4 and days() == set()
    now = store.scores(spark, path).toPandas().sort_values(key, ignore_index=True)
    want = scorer(bars).toPandas().sort_values(key, ignore_index=True)
    assert len(now) == 360 and set(now[store.VERSION]) == {"new"}
    for p in O.PROBS:
        assert np.allclose(now[p], want[p])
    assert now.late.notna().sum() == 80


def test_a_day_without_two_classes_before_it_waits(spark, tmp_path):
    path, bars = str(tmp_path / "scores"), bars_of(spark, days=3).withColumn("label", F.lit("LONG"))
    store.save_scores(bars.limit(0).withColumns({p: F.lit(0.0) for p in O.PROBS}), path, "none")
    bars.where("trade_date = DATE'2026-05-01'").limit(1).withColumns({p: F.lit(0.5) for p in O.PROBS}).withColumn(store.VERSION, F.lit("x")).write.mode("append").partitionBy("trade_date").parquet(path)
    assert store.extend_scores(bars, path, O.logistic(max_iter=3), "label", "two", INPUTS, 0).count() == 0


def test_boosting_stops_early_on_noise_only(spark):
    bars = bars_of(spark, days=8, n=40)
    folds = P.block_folds(bars, 2)
    options = dict(rounds=12, depth=2, step=0.3, hold_back=0.3)
    noise = bars.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in O.CLASSES]), (F.pmod(F.xxhash64("ts", "symbol"), F.lit(3)) + 1).cast("int")))
    used = O.rounds_used(noise, folds, "label", INPUTS, None, **options).toPandas()
    assert len(used) == 6 and (used.max_rounds == 12).all() and (used["rounds"] < 12).any() and (used["rounds"] >= 1).all()
    real = O.rounds_used(bars, folds, "label", INPUTS, None, **options).toPandas()
    assert real["rounds"].sum() > used["rounds"].sum()
    full = O.boosted(3, 2)(O.training_rows(bars, "label", INPUTS), INPUTS)
    assert full.rounds == dict.fromkeys(O.CLASSES, 3)


def test_audit_folds_fall_through_to_the_digest(spark, tmp_path):
    bars = bars_of(spark, days=3, symbols=[f"S{i}" for i in range(8)], n=12).withColumn("ret", F.lit(0.1))
    P.save_fold_map(spark.createDataFrame([("S0_01_May_26", 4), ("S1_02_May_26", 2)], "symbol string, fold int"), str(tmp_path / "map"))
    known = P.load_fold_map(spark, str(tmp_path / "map"))
    assert {tuple(r) for r in known.collect()} == {("S0", 4), ("S1", 2)}
    out = audit.prediction_audit(bars, known, {"lr": O.logistic(max_iter=3)}, "label", "ret", INPUTS).toPandas()
    import hashlib
    fold = {f"S{i}": int(hashlib.md5(f"S{i}".encode()).hexdigest(), 16) % 5 for i in range(8)} | {"S0": 4, "S1": 2}
    assert len(out) == 288 and dict(zip(out.symbol, out.fold)) == fold and out.pred_lr.isin(O.CLASSES).all()
    assert out.groupby(["symbol", out.ts.dt.date]).roc_9pct.apply(lambda x: x.isna().sum()).eq(9).all()


# --------------------------------------------------------------------------- feeds

@pytest.mark.parametrize("keep", [True, False])
def test_counts_of_the_write(spark, tmp_path, keep):
    rows = [("A", T0, 1.0, 5), ("A", T0 - timedelta(hours=3), 1.0, 5), (None, T0, 1.0, 5), ("B", T0 + timedelta(minutes=1), 2.0, None)]
    df = spark.createDataFrame(rows if keep else [], "symbol string, ts timestamp, ltp double, trade_qty long").withColumn("trade_date", F.to_date("ts"))
    got = sinks.clean_to_table(df, str(tmp_path / "out"), C.clean_ticks, keep=("trade_date",))
    assert got == ({"raw_rows": 4, "clean_rows": 2} if keep else {"raw_rows": 0, "clean_rows": 0})
    if keep:
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([("x=1.parquet", 1), ("x=1.parquet", 2), ("y z.parquet", 3)], "name string, v long")
    sinks.write_named_files(df, str(tmp_path / "out"), "name")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.parquet")) == ["x=1.parquet", "y z.parquet"]
    got = files.list_files(spark, [str(tmp_path / "out")]).select("file_name").collect()
    assert len(got) == 2 and spark.read.parquet(str(tmp_path / "out" / "x=1.parquet")).count() == 2


# --------------------------------------------------------------------------- streams

def test_live_model_signals_equal_the_batch(spark, tmp_path):
    from tests.test_sequences import random_bars
    bars = spark.createDataFrame(random_bars(groups=6, n=80, seed=8).drop(columns=["prob_long", "prob_short"]))
    bars.repartition(3).write.parquet(str(tmp_path / "bars"))
    batch, scores, trades, signals = streams.model_replay(spark, str(tmp_path / "bars"), ["delta_1m", "volume_1m", "roc_3"], 0.3)
    key = ["symbol", "ts"]
    a, b = (df.select(*key, *O.PROBS).toPandas().sort_values(key, ignore_index=True) for df in (batch, scores))
    pd.testing.assert_frame_equal(a, b)
    facts = lambda df: sorted(map(tuple, df.select("symbol", "trade_date", *streams._SIGNAL_FACTS).collect()))
    assert facts(signals) == facts(trades) and len(facts(trades)) > 3


def test_late_rows_of_all_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, at in enumerate([T0, T0 + timedelta(hours=2), T0, T0 + timedelta(hours=3), T0]):
        px = {f"{s}{i}": 10.0 + i for s in ("bid", "ask", "bqty", "aqty") for i in range(1, 6)}
        pd.DataFrame([{"symbol": "A", "trade_date": at.date(), "ts": at, "seq": k, "ltp": 10.0, **px}]).to_parquet(folder / f"p{k}.parquet", coerce_timestamps="us")
        time.sleep(0.02)
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    late = live.count_late_rows(spark)
    try:
        query = live.run_to_table(live.live_bars(stream, "1 minute", "30 seconds", session=False), str(tmp_path / "bars"), str(tmp_path / "ckpt"))
        deadline = time.time() + 20
        while late.of(query) < live.late_rows(query) and time.time() < deadline:
            time.sleep(0.2)
        assert late.of(query) == live.late_rows(query) >= 1
    finally:
        spark.streams.removeListener(late)


# --------------------------------------------------------------------------- momentum, paths, controls, touches

def test_momentum_of_a_full_day_with_a_filtered_result(spark):
    from tests.test_sequences import random_bars, walk
    pdf = random_bars(groups=8, n=375, seed=4, step=1)
    trades = Q.sequence_trades(spark.createDataFrame(pdf), Q.pair_table(spark, ["L28_S25"]))
    began = time.time()
    done = trades.where("rejection_reason = 'EXECUTED' AND entry_price > 0").toPandas()
    assert time.time() - began < 30
    every = trades.toPandas()
    assert len(done) == (every.rejection_reason == "EXECUTED").sum() and len(every) == 16
    for r in every.itertuples():
        bars = pdf[pdf.symbol == r.symbol].reset_index(drop=True)
        marks = walk(bars, 0.28 if r.direction == "LONG" else 0.25, 1 if r.direction == "LONG" else -1)
        assert (r.max_stage == "TRIGGERED") == (len(marks) == 4)
        if len(marks) == 4:
            assert r.entry_price == bars.ltp[marks[3]]


def brute_path(bars, ts, entry, sign, horizon):
    later = [b for b in bars if b[0] > ts]
    if not later:
        return None
    up = [(b[1] if sign > 0 else b[2], b[2] if sign > 0 else b[1]) for b in later]
    move = lambda x: (x - entry) / entry * 1e4 * sign
    best = [move(u) for u, _ in up]
    worst = [move(w) for _, w in up]
    k = best.index(max(best))
    close = [entry] + [b[3] for b in later]
    steps = [((np.log(close[i + 1]) - np.log(close[i])) * 1e4) ** 2 for i in range(min(horizon, len(later)))]
    return (max(best), k + 1, min(worst), worst.index(min(worst)) + 1, min(worst[:k + 1]), move(later[min(horizon, len(later)) - 1][3]), move(later[-1][3]), len(later), sum(steps))


@pytest.mark.parametrize("direction", ["LONG", "SHORT"])
def test_paths_against_plain_walks(spark, direction):
    rng = np.random.default_rng(5)
    days = {}
    rows = []
    for s in ("A", "B"):
        px = 100.0
        for i in range(40):
            px *= 1 + int(rng.integers(-3, 4)) / 1000
            r = (T0 + timedelta(minutes=i), px + int(rng.integers(0, 3)) / 4, px - int(rng.integers(0, 3)) / 4, px)
            days.setdefault(s, []).append(r)
            rows.append((s, T0.date(), *r))
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp, high_price double, low_price double, close_price double")
    # signals at bars, between bars, before the first and after the last; two at one bar; none on symbol B but one
    at = [("A", T0 + timedelta(minutes=m, seconds=x), 100.0 + m) for m, x in ((0, 0), (3, 30), (3, 0), (3, 0), (20, 0), (38, 0), (39, 0), (50, 0), (-5, 0))] + [("B", T0, 99.0)]
    signals = spark.createDataFrame([(s, T0.date(), t, p, k) for k, (s, t, p) in enumerate(at)], "symbol string, trade_date date, ts timestamp, entry double, id int")
    got = {r.id: r for r in H.excursions(signals, bars, direction, "entry", horizon=7).collect()}
    for k, (s, t, p) in enumerate(at):
        want = brute_path(days[s], t, p, 1 if direction == "LONG" else -1, 7)
        assert (k in got) == (want is not None)
        if want:
            r = got[k]
            assert (r.mfe_bps, r.mfe_minute, r.mae_bps, r.mae_minute, r.mae_before_mfe_bps, r.ret_60m_bps, r.ret_eod_bps, r.bars_to_close, r.realized_var_60m) == pytest.approx(want)


def test_controls_of_crowded_and_short_keys(spark):
    rows = [(f"S{s}", T0.date(), T0 + timedelta(minutes=m), 1.0, m) for s in range(30) for m in range(3) if m or s < 12]
    pool = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp, close_price double, minute_of_day int")
    signals = pool.where("symbol IN ('S0', 'S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8', 'S9')")
    out = H.matched_controls(signals, pool, ["trade_date", "minute_of_day"], n=5).toPandas()
    sizes = out.groupby("signal_id").symbol.agg(["size", "nunique"])
    assert (sizes["size"] == sizes["nunique"]).all() and sorted(sizes["size"].unique()) == [2, 5]  # minute 0 has two quiet symbols
    often = out[out.ts != pd.Timestamp(T0)].symbol.value_counts()
    assert len(often) == 20 and set(out.draw_no) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("n", [1, 2, 33, 64])
def test_first_touch_against_plain_search(spark, n):
    rng = np.random.default_rng(n)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.006, n)))
    bars = spark.createDataFrame([("A", T0.date(), T0 + timedelta(minutes=i), float(x)) for i, x in enumerate(px)], "symbol string, trade_date date, ts timestamp, ltp double")
    got = {r.ts: r.first_touch for r in L.first_touch_label(bars).collect()}
    for i, x in enumerate(px):
        up = next((k for k in range(i + 1, n) if px[k] >= x * 1.015), n)
        down = next((k for k in range(i + 1, n) if px[k] <= x * 0.985), n)
        assert got[T0 + timedelta(minutes=i)] == ("LONG" if up < down else "SHORT" if down < n else "NO_TRADE")


def test_statistics_from_one_table_of_counts(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": [None, "x", "y"] * 40, "pnl": rng.integers(-3, 5, 120) / 10})
    got = {r.g: r for r in S.trade_metrics(spark.createDataFrame(pdf), ["g"]).collect()}
    for g, rows in pdf.groupby("g", dropna=False):
        p, r = rows.pnl, got[g if isinstance(g, str) else None]
        wins, losses = p[p > 0].sum(), abs(p[p <= 0].sum())
        assert (r.num_trades, r.win_rate, r.mean_pnl, r.median_pnl, r.cumulative_pnl, r.profit_factor) == pytest.approx(
            (len(p), round((p > 0).mean(), 4), round(p.mean(), 6), p.median(), round(p.sum(), 6), round(wins / losses, 4)))
    one = R.exact_quantiles(spark.createDataFrame(pdf), "pnl", [0.5], more={"m": R.MEAN, "s": R.DEVIATION}).first()
    assert (one.m, one.s) == pytest.approx((pdf.pnl.mean(), pdf.pnl.std(ddof=0)))


# --------------------------------------------------------------------------- one class or none

@pytest.mark.parametrize("kept, wanted", [("LONG", [1.0, 0.0, 0.0]), ("NO_TRADE", [0.0, 0.0, 1.0]), (None, [1 / 3] * 3)])
def test_every_fold_is_scored_whatever_its_classes(spark, kept, wanted):
    bars = bars_of(spark, days=4, n=12).withColumn("label", F.lit(kept).cast("string"))
    folds = P.block_folds(bars, 2)
    for fit in (O.logistic(max_iter=3), O.forest(3, 2, 1, every=2), O.boosted(3, 2)):
        out = O.out_of_fold(bars, folds, fit, "label", INPUTS, None).toPandas()
        assert len(out) == bars.count() and np.allclose(out[list(O.PROBS)], wanted)
    assert (O.rounds_used(bars, folds, "label", INPUTS, None, rounds=4, depth=2).toPandas()["rounds"] == 0).all()
    run = lambda train, val: O.coefficients(train, "label", INPUTS).select("feature", "coefficient").unionByName(O.tree_importance(train, "label", INPUTS).toDF("feature", "coefficient"))
    zeros = O.per_fold(bars, folds, run, "label", None).toPandas()
    assert len(zeros) == 2 * 4 * len(INPUTS) and (zeros.coefficient == 0).all()


def test_a_class_that_training_lacks_scores_nothing(spark):
    bars = bars_of(spark, days=2).where("label <> 'SHORT'")
    score = O.boosted(2, 2)(O.training_rows(bars, "label", INPUTS), INPUTS)
    out = score(bars).toPandas()
    assert score.rounds == {"LONG": 2, "SHORT": 0, "NO_TRADE": 2} and (out.prob_short == 0).all()
    assert np.allclose(out[list(O.PROBS)].sum(axis=1), 1.0)


def test_a_class_that_training_lacks_has_coefficients_of_zero(spark):
    for lacked in O.CLASSES:
        rows = bars_of(spark, days=2).where(F.col("label") != lacked)
        out = O.coefficients(rows, "label", INPUTS).toPandas()
        assert len(out) == 6 and set(out["class"]) == set(O.CLASSES)
        assert np.allclose(out.coefficient[out["class"] == lacked], 0, atol=1e-3) and (out.coefficient[out["class"] != lacked].abs() > 0.01).any()


@pytest.mark.parametrize("share", [0.0001, 0.9999])
def test_boosting_with_nothing_or_all_held_back(spark, share):
    bars = bars_of(spark, days=2)
    score = O.boosted(3, 2, hold_back=share)(O.training_rows(bars, "label", INPUTS), INPUTS)
    assert np.allclose(score(bars).toPandas()[list(O.PROBS)].sum(axis=1), 1.0)


def test_each_signal_ranks_all_controls_anew(spark):
    key = {"trade_date": date(2026, 5, 1), "ts": T0}
    rows = [{"symbol": f"C{i}", "id": i, "close_price": 1.0, **key} for i in range(40)]
    pool = spark.createDataFrame(rows, "symbol string, id long, close_price double, trade_date date, ts timestamp")
    signals = spark.createDataFrame([{"symbol": f"L{i}", "id": 1000 + i, "close_price": 1.0, **key} for i in range(6)], pool.schema)
    order = lambda s, c: (s * 7919 + c * 104729) % 1009
    got = H.matched_controls(signals, pool, ["trade_date", "ts"], n=5, draw=H.PairDraw(order), signal_id=F.col("id"), control_id=F.col("id")).toPandas()
    for i in range(6):
        mine = got[got.signal_id == 1000 + i].sort_values("draw_no")
        assert mine.symbol.tolist() == [f"C{c}" for c in sorted(range(40), key=lambda c: (order(1000 + i, c), c))[:5]]
