from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.clock import slug
from tidemark.functions.scalars import is_equity, md5_fold, pair_thresholds, percent_value
from tidemark.operators import clean as C
from tidemark.operators import profile as P
from tidemark.operators.schema import GARBAGE_COLUMNS, depth_of, is_unified
from tidemark.sources import files as S
from tidemark.sources import sinks as W


def day_rows(spark, symbols, n=50, start=datetime(2026, 5, 29, 3, 45)):
    rows = [{"ts": start + timedelta(milliseconds=10 * i), "symbol": s, "ltp": 100.0, "seq": i,
             **{c: None for c in GARBAGE_COLUMNS}, "bid1": 99.9, "ask1": 100.1, "bqty1": 10.0, "aqty1": 10.0}
            for s in symbols for i in range(n)]
    schema = ("ts timestamp, symbol string, ltp double, seq bigint, bid1 double, ask1 double, bqty1 double, aqty1 double, "
              + ", ".join(f"`{c}` string" for c in GARBAGE_COLUMNS))
    return spark.createDataFrame(rows, schema)


def test_split_drops_sentinels(spark, tmp_path):
    raw = C.with_trade_date(day_rows(spark, ["IFCI", "HDFCBANK", "MFticks", "dom_snapshots"]))
    stats = W.split_day(C.remove_garbage_columns(raw), str(tmp_path / "split"))
    out = spark.read.parquet(str(tmp_path / "split"))
    assert (stats["rows"], stats["sentinel_rows"]) == (200, 100)
    assert {r.symbol: r.n for r in out.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {"IFCI": 50, "HDFCBANK": 50}
    again = W.split_day(C.remove_garbage_columns(raw), str(tmp_path / "split"), existing=out)
    assert again["rows"] == 200 and spark.read.parquet(str(tmp_path / "split")).count() == 100


def test_clean_book(spark):
    raw = day_rows(spark, ["IFCI"]).withColumn("ask1", F.when(F.col("seq") < 10, 99.0).otherwise(F.col("ask1")))
    out = C.clean_book(raw, keep=("seq",))
    assert out.count() == 40 and dict(out.dtypes)["bqty1"] == "bigint" and "im" not in out.columns
    early = day_rows(spark, ["IFCI"], start=datetime(2026, 5, 29, 3, 44, 59, 800_000))
    assert C.clean_book(early).count() == 30  # 09:15:00 local opens, half-open
    assert C.clean_book(day_rows(spark, ["IFCI"], start=datetime(2026, 5, 29, 10, 0))).count() == 0


def test_tick_columns(spark):
    t = spark.createDataFrame([(datetime(2026, 5, 29, 4), "A", None, 1.0, 5.0, "BUY")],
                              "ts timestamp, symbol string, security_id string, ltp double, trade_qty double, aggressor string")
    out = C.clean_ticks(t)
    assert "security_id" not in out.columns and dict(out.dtypes)["trade_qty"] == "bigint"


@pytest.mark.parametrize("hours, fired", [((4, 5, 6), set()), ((9, 12, 15), {"median_in_local_session"}), ((1, 5, 23), {"outside_utc_band"})])
def test_tz_rules(spark, hours, fired):
    df = spark.createDataFrame([(datetime(2026, 5, 29, h),) for h in hours], "ts timestamp")
    assert {r.rule for r in P.tz_sanity(df).collect() if r.fired} == fired


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "ts int, symbol string")
    assert P.duplicate_audit(df).first().duplicates == 2


def test_time_profile_blocks(spark):
    """Block edges must not hide gaps or disorder."""
    t0 = datetime(2026, 5, 29, 4)
    secs = [0, 1, 1, 5, 3, 8, 8, 9]
    df = spark.createDataFrame([("A", t0 + timedelta(seconds=s), i) for i, s in enumerate(secs)], "symbol string, ts timestamp, seq bigint")
    for chunk in (1, 2, 3, 100):
        r = P.time_profile(df, chunk=chunk).first()
        assert (r.rows, r.out_of_order, r.monotonic, r.duplicate_ts, r.min_gap_us) == (8, 1, False, 2, 1_000_000)


def test_names(spark):
    one = spark.range(1)
    assert one.select(slug(F.lit("ifci"), F.lit("2026-06-01").cast("date"))).first()[0] == "IFCI_01_Jun_26"
    assert one.select(*[t.alias(n) for t, n in zip(pair_thresholds(F.lit("L25_S30")), "ab")]).first()[:] == (0.25, 0.30)
    assert [one.select(percent_value(F.lit(v))).first()[0] for v in ("12.5%", "0.3", "", "x")] == [0.125, 0.3, 0.0, 0.0]
    assert [one.select(is_equity(F.lit(v))).first()[0] for v in ("IFCI", "NIFTY", "ABC-FUT", "ABC-24JAN-CE", "1234")] == [True] + [False] * 4
    assert depth_of(["bid1", "bid20", "bidx", "bqty30"]) == 20
    assert is_unified([f"{s}{i}" for s in ("bqty", "aqty") for i in range(1, 6)]) and not is_unified(["bqty1", "aqty1"])


def test_md5_fold(spark):
    import hashlib
    names = ["IFCI", "HDFCBANK", "TCS", "X1", "zz"]
    got = spark.createDataFrame([(n,) for n in names], "symbol string").select("symbol", md5_fold("symbol").alias("f")).collect()
    assert {r.symbol: r.f for r in got} == {n: int(hashlib.md5(n.upper().encode()).hexdigest(), 16) % 5 for n in names}


def test_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x"))
    import glob
    import shutil
    part = glob.glob(str(tmp_path / "x" / "*.parquet"))[0]
    for root, names in (("r1", ["ticks_year=2026_month=06_day=01_ticks.parquet", "other.parquet"]),
                        ("r2", ["ticks_year=2026_month=06_day=01_ticks.parquet", "doms_year=2026_month=06_day=02_doms.parquet"])):
        (tmp_path / root).mkdir()
        for n in names:
            shutil.copy(part, tmp_path / root / n)
    (tmp_path / "r2" / "tiny.parquet").write_bytes(b"x")
    found = {(r.kind, str(r.trade_date)) for r in S.discover_day_files(spark, str(tmp_path / "r2")).collect()}
    assert found == {("ticks", "2026-06-01"), ("doms", "2026-06-02")}
    files = S.list_files(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")])
    best = {r.file_name: r.root_no for r in S.first_root_wins(S.usable_files(files)).collect()}
    assert best["ticks_year=2026_month=06_day=01_ticks.parquet"] == 0 and "tiny.parquet" not in best


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    t0 = datetime(2026, 5, 28, 4)
    rows = lambda n, day: C.with_trade_date(day_rows(spark, ["A"], n, t0 + timedelta(days=day))).select("ts", "symbol", "trade_date", "ltp")
    W.write_table(rows(5, 0).unionByName(rows(7, 1)), path)
    W.replace_days(rows(3, 1), path)
    W.incremental_append(rows(9, 1).unionByName(rows(4, 2)), spark.read.parquet(path), path)
    counts = {str(r.trade_date): r.n for r in spark.read.parquet(path).groupBy("trade_date").agg(F.count("*").alias("n")).collect()}
    assert counts == {"2026-05-28": 5, "2026-05-29": 3, "2026-05-30": 4}
