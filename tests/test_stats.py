from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import oof as O
from tidemark.models import splits as P
from tidemark.operators import compare as C
from tidemark.operators import metrics as X
from tidemark.operators import paths as H
from tidemark.operators import ranks as R
from tidemark.operators import stats as S
from tidemark.operators.study import clustered_t

T0 = datetime(2026, 5, 29, 4, 0)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(900) < 0.34, 5.0, rng.normal(0, 10, 900).round(3))
    pdf = pd.DataFrame({"x": x, "g": rng.integers(0, 3, 900), "symbol": [f"S{i % 7}" for i in range(900)], "ts": range(900),
                        "trade_date": [f"d{i % 5}" for i in range(900)]})
    return pdf, spark.createDataFrame(pdf)


def test_quantiles(skewed):
    pdf, df = skewed
    probs = [0.0, 0.05, 0.5, 0.953, 1.0]
    assert R.exact_quantiles(df, "x", probs).first().q == pytest.approx(list(np.quantile(pdf.x, probs)))
    for r in R.exact_quantiles(df, "x", probs, ["g"]).collect():
        assert r.q == pytest.approx(list(np.quantile(pdf.x[pdf.g == r.g], probs)))


@pytest.mark.parametrize("descending", [False, True])
def test_global_rank(skewed, descending):
    pdf, df = skewed
    got = R.global_rank(df, "x", ["symbol", "ts"], descending=descending).toPandas().set_index("ts").rn
    want = pdf.sort_values(["x", "trade_date", "symbol", "ts"], ascending=[not descending, True, True, True]).ts
    assert got.loc[want].tolist() == list(range(1, 901))
    top = R.top_fraction(df, "x", 0.01, ["symbol", "ts"]).count()
    assert top == 9


@pytest.mark.parametrize("n", [10, 11, 23, 97, 399, 1000])
def test_deciles_match_qcut(spark, n):
    got = spark.range(1, n + 1).select(R.decile_of("id", F.lit(n)).alias("d"), "id").orderBy("id").toPandas().d
    assert got.tolist() == (pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1).tolist()


def test_average_precision(skewed):
    pdf, df = skewed
    y = pdf.x * 0 + (pdf.ts % 3 == 0)
    order = pdf.x.groupby(pdf.x).ngroup()
    hits = seen = 0
    total = 0.0
    for v in sorted(order.unique(), reverse=True):
        at = order == v
        hits, seen = hits + y[at].sum(), seen + at.sum()
        total += y[at].sum() / y.sum() * hits / seen
    got = X.average_precision(df, "x", F.col("ts") % 3 == 0).first()
    assert got.average_precision == pytest.approx(total)


def test_mcc(spark):
    rng = np.random.default_rng(2)
    t, p = rng.integers(0, 3, 300), rng.integers(0, 3, 300)
    p[:150] = t[:150]
    c = np.zeros((3, 3))
    np.add.at(c, (t, p), 1)
    s, k = c.sum(), np.trace(c)
    pk, tk = c.sum(0), c.sum(1)
    want = (k * s - pk @ tk) / np.sqrt((s * s - pk @ pk) * (s * s - tk @ tk))
    df = spark.createDataFrame(pd.DataFrame({"t": t.astype(str), "p": p.astype(str)}))
    assert X.mcc(df, "t", "p").first().mcc == pytest.approx(want)
    assert X.mcc(df.withColumn("p", F.lit("0")), "t", "p").first().mcc == 0.0


def test_excursions(spark):
    close = [100.0, 101.0, 99.0, 103.0, 98.0]
    bars = spark.createDataFrame([{"symbol": "A", "trade_date": T0.date(), "ts": T0 + timedelta(minutes=i), "close_price": c,
                                   "high_price": c + 0.5, "low_price": c - 0.5} for i, c in enumerate(close)])
    r = H.excursions(bars, bars, "LONG").orderBy("ts").collect()
    assert len(r) == 4  # the last bar has no path
    a = r[0]
    assert (a.mfe_bps, a.mfe_minute, a.mae_bps, a.mae_minute, a.mae_before_mfe_bps) == pytest.approx((350.0, 3, -250.0, 4, -150.0))
    assert (a.ret_60m_bps, a.bars_to_close) == (pytest.approx(-200.0), 4)
    steps = np.diff(np.log(close)) * 1e4
    assert a.realized_var_60m == pytest.approx((steps ** 2).sum())


def test_controls(spark):
    rows = [{"symbol": f"S{s}", "trade_date": T0.date(), "ts": T0 + timedelta(minutes=m), "close_price": 100.0, "minute_of_day": m}
            for s in range(40) for m in range(3)]
    pool = spark.createDataFrame(rows)
    signals = pool.where("symbol IN ('S0', 'S1') AND minute_of_day = 1")
    out = H.matched_controls(signals, pool, ["trade_date", "minute_of_day"], n=20).toPandas()
    assert out.groupby("signal_id").size().tolist() == [20, 20]
    assert not set(out.symbol) & {"S0", "S1"} and not out.duplicated(["signal_id", "symbol"]).any()
    again = H.matched_controls(signals, pool, ["trade_date", "minute_of_day"], n=20).toPandas()
    assert set(map(tuple, out.values)) == set(map(tuple, again.values))
    nowhere = signals.withColumn("minute_of_day", F.lit(99))
    assert H.matched_controls(nowhere, pool, ["trade_date", "minute_of_day"], n=20).count() == 0
    assert H.matched_controls(nowhere, pool, ["trade_date", "minute_of_day"], ["trade_date"], n=20).count() == 40


def test_clustered_t(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"trade_date": rng.integers(0, 6, 200).astype(str), "grp": rng.choice(["A", "B"], 200), "value": rng.normal(0, 1, 200), "m": "x"})
    day = pdf.groupby(["trade_date", "grp"]).value.mean().unstack().dropna()
    d = day.A - day.B
    r = clustered_t(spark.createDataFrame(pdf), ["m"]).first()
    assert (r.day_diff, r.t_stat, r.days) == pytest.approx((d.mean(), d.mean() / (d.std(ddof=1) / np.sqrt(len(d))), len(d)))


def test_spread_segments(spark):
    df = spark.createDataFrame([(s, v) for s, v in zip("AABBCCDD", [.05, .05, .15, .15, .25, .25, .35, .35])], "symbol string, spread double")
    rows = {r.symbol: r for r in S.spread_segments(df).collect()}
    assert rows["A"].median_spread == pytest.approx(0.20)
    assert [rows[s].segment for s in "ABCD"] == ["TIGHT", "TIGHT", "WIDE", "WIDE"]


def test_purge_and_blocks(spark):
    at = lambda d, h: {"trade_date": datetime(2026, 6, d).date(), "ts": datetime(2026, 6, d, h), "symbol": "A"}
    bars = spark.createDataFrame([at(d, h) for d in range(1, 12) for h in (0, 12, 23)])
    walk = P.walk_forward_folds(bars, 5)
    train, val = P.split_fold(bars, walk, 1, 60)
    assert (train.count(), val.count()) == (14, 3)  # 23:00 of day 5 reaches into day 6
    sizes = {(r.fold, r.role): r.rows for r in P.split_sizes(bars, walk, 60).collect()}
    assert sizes[(1, "train")] == 14 and sizes[(6, "train")] == 29
    blocks = P.block_folds(bars, 5).toPandas()
    assert blocks[blocks.role == "val"].groupby("fold").size().tolist() == [3, 2, 2, 2, 2]
    assert blocks[blocks.role == "purged"].groupby("fold").size().tolist() == [1, 2, 2, 2, 1]
    assert all(r.passed for r in P.check_folds(P.seeded_folds(spark.range(23).select(F.col("id").cast("string").alias("symbol")))).collect())


def test_shuffle_keeps_values(skewed):
    _, df = skewed
    out = O.shuffled(df, "x", ["g"]).toPandas()
    base = df.toPandas()
    for g in range(3):
        assert sorted(out.x[out.g == g]) == sorted(base.x[base.g == g])
    assert (out.sort_values("ts").x.to_numpy() != base.sort_values("ts").x.to_numpy()).mean() > 0.4


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 600
    a = rng.normal(0, 1, n)
    pdf = pd.DataFrame({"symbol": "A", "trade_date": [datetime(2026, 6, 1 + i % 6).date() for i in range(n)], "ts": [T0 + timedelta(minutes=i) for i in range(n)],
                        "f1": a, "f2": rng.normal(0, 1, n), "label": np.where(a > 0.5, "LONG", np.where(a < -0.5, "SHORT", "NO_TRADE"))})
    df = spark.createDataFrame(pdf)
    scored = O.out_of_fold(df, P.block_folds(df, 2), O.logistic(max_iter=20), "label", ["f1", "f2"], None)
    e = O.evaluate(scored, "label").first()
    assert e.rows == n and e.mcc > 0.6 and e.ap_long > 0.9
    p = scored.select((F.col("prob_long") + F.col("prob_short") + F.col("prob_no_trade")).alias("s")).toPandas().s
    assert p.to_numpy() == pytest.approx(1.0)
    O.fit_and_save(df, "label", str(tmp_path / "m"), ["f1", "f2"], trees=5)
    assert O.load_scorer(str(tmp_path / "m"), ["f1", "f2"])(df).count() == n


def test_table_diff(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y"), (3, None, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, 2.5, "y"), (4, 1.0, "w")], "k int, v double, s string")
    rows = {r.column: (r.rows, r.mismatches, r.examples) for r in C.table_diff(a, b, ["k"]).collect()}
    assert rows == {"<rows>": (4, 2, "3;4"), "v": (2, 1, "2"), "s": (2, 0, "")}
