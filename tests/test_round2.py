"""Losses that must not happen again: lost bars, files, days, groups and folds."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.models import oof as O
from tidemark.models import splits as P
from tidemark.operators import paths as H
from tidemark.operators import ranks as R
from tidemark.operators.bars import book_bars
from tidemark.operators.compare import table_diff
from tidemark.operators.profile import bar_count_pivot
from tidemark.sources import files
from tidemark.streaming import live as L

T0 = datetime(2026, 5, 29, 4, 0)


def snapshots(n=240, symbols=("AAA", "BBB"), step=13):
    rows = []
    for s in symbols:
        for no in range(n):
            px = 1000 + (no * 7919 + len(rows)) % 11
            r = {"symbol": s, "trade_date": T0.date(), "ts": T0 + timedelta(seconds=no * step), "seq": no, "ltp": px / 10}
            for i in range(1, 6):
                r |= {f"bid{i}": (px - i) / 10, f"ask{i}": (px + i) / 10, f"bqty{i}": 100 + (no * 31) % 70, f"aqty{i}": 100 + (no * 37) % 70}
            rows.append(r)
    return pd.DataFrame(rows)


def write(pdf, folder, name):
    pdf.to_parquet(folder / name, coerce_timestamps="us")


def replayed(spark, folder, out, once=True):
    schema = spark.read.parquet(str(folder)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = L.run_to_table(L.live_bars(stream, "1 minute", "30 seconds", session=False), str(out / "bars"), str(out / "ckpt"))
    rest = L.flush(spark, str(out / "ckpt"))
    return spark.read.parquet(str(out / "bars")).drop("batch_id").unionByName(rest), query


COLS = ["symbol", "ts", "open_price", "high_price", "low_price", "close_price", "ltp"]


def batch(spark, folder):
    from tidemark.operators.bars import enrich_with_ohlc, ohlc_bars
    df = spark.read.parquet(str(folder))
    return enrich_with_ohlc(book_bars(df), ohlc_bars(df)).select(*COLS)


@pytest.mark.parametrize("parts", [1, 5])
def test_every_bar_whatever_the_batches(spark, tmp_path, parts):
    pdf = snapshots().sort_values("ts", kind="stable").reset_index(drop=True)
    folder = tmp_path / "in"
    folder.mkdir()
    size = -(-len(pdf) // parts)
    for k in range(parts):
        write(pdf.iloc[k * size:(k + 1) * size], folder, f"p{k}.parquet")
    live, query = replayed(spark, folder, tmp_path)
    diff = {r.column: r.mismatches for r in table_diff(live.select(*COLS), batch(spark, folder), ["symbol", "ts"], rtol=1e-9).collect()}
    assert set(diff.values()) == {0} and L.late_rows(query) == 0


def test_a_row_seconds_late_still_counts(spark, tmp_path):
    pdf = snapshots(60, ("AAA",))
    late = pdf.iloc[[4]].assign(ltp=150.0)  # of the first minute, sent after the second one began
    folder = tmp_path / "in"
    folder.mkdir()
    write(pdf.drop(index=4).iloc[:5], folder, "p0.parquet")
    write(pd.concat([late, pdf.iloc[6:]]), folder, "p1.parquet")
    live, query = replayed(spark, folder, tmp_path)
    assert live.orderBy("ts").first().high_price == 150.0
    diff = {r.column: r.mismatches for r in table_diff(live.select(*COLS), batch(spark, folder), ["symbol", "ts"], rtol=1e-9).collect()}
    assert set(diff.values()) == {0} and L.late_rows(query) == 0


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    pdf = snapshots(90, ("AAA",))
    folder = tmp_path / "in"
    folder.mkdir()
    write(pdf.drop(index=[2, 3]).iloc[:40], folder, "p0.parquet")
    write(pdf.iloc[[42]], folder, "p1.parquet")
    write(pd.concat([pdf.iloc[[2, 3]], pdf.iloc[43:]]), folder, "p2.parquet")
    _, query = replayed(spark, folder, tmp_path)
    assert L.late_rows(query) == 2


def test_restart_goes_on_from_the_state(spark, tmp_path):
    pdf = snapshots().sort_values("ts", kind="stable").reset_index(drop=True)
    folder = tmp_path / "in"
    folder.mkdir()
    write(pdf.iloc[:201], folder, "p0.parquet")
    replayed(spark, folder, tmp_path)
    write(pdf.iloc[201:], folder, "p1.parquet")
    live, _ = replayed(spark, folder, tmp_path)
    diff = {r.column: r.mismatches for r in table_diff(live.select(*COLS), batch(spark, folder), ["symbol", "ts"], rtol=1e-9).collect()}
    assert set(diff.values()) == {0}


def test_equal_times_open_and_close_by_sequence(spark, tmp_path):
    pdf = snapshots(30, ("AAA",))
    pdf["ts"] = [T0 + timedelta(seconds=10 * (no // 10) + 60 * (no // 10)) for no in range(30)]
    folder = tmp_path / "in"
    folder.mkdir()
    write(pdf.sample(frac=1, random_state=1), folder, "p0.parquet")
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
    L.run_to_table(L.book_bars_stream(stream, delay="0 seconds"), str(tmp_path / "bars"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "bars")).orderBy("ts").first()
    assert (got.open_price, got.close_price) == (pdf.ltp[0], pdf.ltp[9])


def test_signal_without_a_path_draws_no_controls(spark):
    rows = [(s, T0.date(), T0 + timedelta(minutes=m), 100.0, 101.0, 99.0, 100.0 + m, 1.0 if (s, m) == ("A", 4) else 0.0)
            for s in "ABC" for m in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp, open_price double, high_price double, low_price double, close_price double, score double")
    got = H.control_lift(bars, "score", fraction=0.01, metrics=["ret_eod_bps"]).collect()
    assert got == [] or (got[0].n_a, got[0].n_b) == (0, 0)


def test_days_of_every_month(spark):
    rows = [("A", datetime(2024, 1, 31, 10)), ("A", datetime(2024, 2, 5, 10)), ("B", datetime(2024, 2, 5, 11))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp").withColumn("trade_date", F.to_date("ts"))
    got = {r.symbol: r.asDict() for r in bar_count_pivot(df).collect()}
    assert got["A"] == {"symbol": "A", "d2024_01_31": 1, "d2024_02_05": 1}
    assert got["B"] == {"symbol": "B", "d2024_01_31": 0, "d2024_02_05": 1}


def test_bad_files_are_named(spark, tmp_path):
    good = snapshots(3)
    write(good, tmp_path, "AAA_29_May_26.parquet")
    (tmp_path / "BBB_29_May_26.parquet").write_bytes(b"PAR1" + bytes(500))
    (tmp_path / "CCC_29_May_26.parquet").write_bytes(b"x")
    bad = {r.path.rpartition("/")[2]: r.reason for r in files.bad_files(spark, str(tmp_path)).collect()}
    assert bad == {"BBB_29_May_26.parquet": "unreadable or without rows", "CCC_29_May_26.parquet": "near-empty"}
    assert files.read_tolerant(spark, str(tmp_path)).where("date_str = '29_May_26'").count() == len(good)
    with pytest.raises(Exception):
        files.read_tolerant(spark, str(tmp_path), skip_bad=False).count()


def test_ranks_keep_null_groups_and_large_integers(spark):
    rows = [("a", 3, 1), (None, 2, 2), (None, 1, 3), ("a", None, 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "g string, v long, id int").withColumn("trade_date", F.lit("d"))
    got = {r.id: (r.rn, r.n) for r in R.global_rank(df, "v", ["id"], ["g"]).collect()}
    assert got == {4: (1, 2), 1: (2, 2), 5: (1, 3), 3: (2, 3), 2: (3, 3)}
    big = spark.createDataFrame([(2 ** 53 + 1, 1), (2 ** 53, 2)], "v long, id int").withColumn("trade_date", F.lit("d"))
    assert {r.id: r.rn for r in R.global_rank(big, "v", ["id"]).collect()} == {2: 1, 1: 2}


def test_every_fold_reports(spark):
    rows = [(f"S{k % 3}", (T0 + timedelta(days=d)).date(), T0 + timedelta(days=d, minutes=k), float(k % 7), float((k * 5) % 11),
             ("LONG", "SHORT", "NO_TRADE")[(k + d) % 3]) for d in range(9) for k in range(30)]
    bars = spark.createDataFrame(rows, "symbol string, trade_date date, ts timestamp, x double, y2 double, label string")
    folds = P.block_folds(bars, 3)
    got = O.fold_means(O.per_fold(bars, folds, lambda train, val: O.coefficients(train, "label", ["x", "y2"]), "label", None), ["class", "feature"], ["coefficient"]).collect()
    assert {r.fold for r in got} == {None, 1, 2, 3} and len(got) == 4 * 6
    one = [r for r in got if (r["class"], r.feature) == ("LONG", "x")]
    assert next(r.coefficient for r in one if r.fold is None) == pytest.approx(sum(r.coefficient for r in one if r.fold is not None) / 3)
