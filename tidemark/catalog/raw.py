"""Queries over raw feeds: cleaning, profiles, file bookkeeping, trades, bars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.inputs import (
    Registry, BAR, BOOK_FEED, SQL_BAR, SQL_LINEITEM, SQL_TICKS, TICK_FEED, book, flat_book,
    lineitem_trades, naive_ts, rd, rounded, sql_book, table, ticks,
)
from tidemark.functions.clock import in_session, slug
from tidemark.operators import bars as B
from tidemark.operators import clean as C
from tidemark.operators import profile as P
from tidemark.operators import trades as T
from tidemark.operators.features import large_trade_flag
from tidemark.session import checkpoint_dir
from tidemark.sources import files as S
from tidemark.sources import sinks as W

_IN_SESSION = ("CAST(ts + INTERVAL '330 minutes' AS TIME) >= TIME '09:15:00' "
               "AND CAST(ts + INTERVAL '330 minutes' AS TIME) < TIME '15:30:00'")
_BOOK_COLS = ["ts", "symbol", "ltp"] + [f"{s}{i}" for s in ("bid", "ask", "bqty", "aqty") for i in range(1, 6)] + ["seq"]
_SLUG = "upper(symbol) || '_' || strftime(trade_date, '%d_%b_%y')"

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --------------------------------------------------------------------------- cleaning

@query("clean_book", f"""
WITH b AS ({sql_book()})
SELECT {', '.join(_BOOK_COLS)} FROM b
WHERE ts IS NOT NULL AND symbol IS NOT NULL AND symbol <> '' AND ask1 > bid1 AND bid1 > 0 AND ask1 > 0 AND {_IN_SESSION}""")
def clean_book(spark, sf):
    return naive_ts(C.clean_book(book(spark, sf), keep=("seq",)))


@query("clean_ticks", f"""
WITH t AS ({SQL_TICKS})
SELECT ts, symbol, ltp, volume, aggressor, trade_qty, seq FROM t WHERE ts IS NOT NULL AND symbol IS NOT NULL AND {_IN_SESSION}""")
def clean_ticks(spark, sf):
    raw = ticks(spark, sf).withColumn("security_id", F.lit(None).cast("string"))
    return naive_ts(C.clean_ticks(raw, keep=("seq",)))


@query("clean_counts", f"""WITH b AS ({sql_book()}), t AS ({SQL_TICKS})
SELECT 'book' AS feed, count(*) AS raw_rows, count(*) FILTER (WHERE ts IS NOT NULL AND symbol IS NOT NULL AND symbol <> '' AND ask1 > bid1 AND bid1 > 0 AND ask1 > 0 AND {_IN_SESSION}) AS clean_rows FROM b
UNION ALL SELECT 'ticks', count(*), count(*) FILTER (WHERE ts IS NOT NULL AND symbol IS NOT NULL AND {_IN_SESSION}) FROM t
UNION ALL SELECT 'no ticks', 0, 0""")
def clean_counts(spark, sf):
    """Counts of the jobs that write the cleaned feeds, an empty one among them."""
    place = f"{checkpoint_dir(spark)}/clean/{uuid.uuid4().hex}"
    feeds = [("book", book(spark, sf), C.clean_book), ("ticks", ticks(spark, sf), C.clean_ticks), ("no ticks", ticks(spark, sf).where("symbol = 'none such'"), C.clean_ticks)]
    counts = [(name, *W.clean_to_table(rows, f"{place}/{name.replace(' ', '_')}", clean, keep=("seq", "trade_date")).values()) for name, rows, clean in feeds]
    return spark.createDataFrame(counts, "feed string, raw_rows long, clean_rows long")


@query("session_filter", f"""
WITH t AS ({SQL_TICKS})
SELECT symbol, trade_date, count(*) AS n FROM t WHERE {_IN_SESSION} GROUP BY ALL""")
def session_filter(spark, sf):
    return ticks(spark, sf).where(in_session("ts")).groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("n"))


@query("tz_sanity", f"""
WITH h AS (SELECT min(hour(ts)) AS lo, max(hour(ts)) AS hi, quantile_cont(hour(ts), 0.5) AS mid FROM ({SQL_TICKS}))
SELECT 'ticks' AS label, lo AS hour_min, hi AS hour_max, mid AS hour_median, rule, severity, fired FROM (
  SELECT *, 'hour_range' AS rule, 'ERROR' AS severity, (lo < 0 OR hi >= 24) AS fired FROM h
  UNION ALL SELECT *, 'median_in_local_session', 'WARN', mid BETWEEN 9 AND 16 FROM h
  UNION ALL SELECT *, 'outside_utc_band', 'WARN', (lo < 2 OR hi > 22) FROM h)""")
def tz_sanity(spark, sf):
    return P.tz_sanity(ticks(spark, sf), "ticks")


@query("dup_audit", f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM ({SQL_LINEITEM}) GROUP BY ts, symbol)""")
def dup_audit(spark, sf):
    return P.duplicate_audit(lineitem_trades(spark, sf), ["ts", "symbol"])


_NULL_COLS = ["doc_id", "quality", "toxic", "source", "lang", "n_chars"]


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM documents LEFT JOIN labels USING (doc_id)"
    for c in _NULL_COLS))
def null_profile(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(*_NULL_COLS)
    return P.null_profile(df)


_PROFILE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dataset_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) * 100.0 / count(*) AS non_null_pct, min({c}) AS min, max({c}) AS max,
  rd(avg({c}), 6) AS mean, rd(stddev_samp({c}), 4) AS std FROM lineitem""" for c in _PROFILE))
def dataset_profile(spark, sf):
    out = P.column_profile(table(spark, sf, "lineitem").select(*_PROFILE))
    return out.withColumns({"mean": rd("mean", 6), "std": rd("std", 4)})


@query("time_profile", f"""
WITH t AS (SELECT symbol, seq, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY symbol ORDER BY seq) AS gap FROM ({SQL_TICKS}))
SELECT symbol, count(*) AS rows, make_timestamp(min(us)) AS first_ts, make_timestamp(max(us)) AS last_ts,
  CAST(count(*) FILTER (WHERE gap < 0) AS BIGINT) AS out_of_order, count(*) FILTER (WHERE gap < 0) = 0 AS monotonic,
  count(*) - count(DISTINCT us) AS duplicate_ts, min(gap) FILTER (WHERE gap > 0) AS min_gap_us
FROM t GROUP BY symbol""")
def time_profile(spark, sf):
    return naive_ts(P.time_profile(ticks(spark, sf), chunk=1000), "first_ts", "last_ts")


@query("symbol_filter", """
SELECT n_name AS symbol, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY 1""")
def symbol_filter(spark, sf):
    listed = (table(spark, sf, "nation").join(
        table(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE")),
        F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_name").alias("symbol")))
    rows = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"))
    return C.within_symbols(rows, listed).groupBy("symbol").agg(F.count(F.lit(1)).alias("suppliers"))


@query("equity_filter", """
SELECT part_symbol AS symbol, count(*) AS n FROM (
  SELECT CASE p_size % 5 WHEN 0 THEN 'NIFTY' WHEN 1 THEN p_brand || '-FUT' WHEN 2 THEN p_brand || '-24JAN-CE'
    WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS part_symbol FROM part)
WHERE part_symbol NOT IN ('NIFTY', 'BANKNIFTY', 'FINNIFTY', 'MIDCPNIFTY', 'SENSEX')
  AND NOT regexp_matches(upper(part_symbol), '-(FUT|CE|PE)') AND NOT regexp_matches(part_symbol, '^[0-9]+$') GROUP BY 1""")
def equity_filter(spark, sf):
    kind = F.col("p_size") % 5
    named = table(spark, sf, "part").select(
        F.when(kind == 0, "NIFTY").when(kind == 1, F.concat("p_brand", F.lit("-FUT")))
        .when(kind == 2, F.concat("p_brand", F.lit("-24JAN-CE")))
        .when(kind == 3, F.col("p_partkey").cast("string")).otherwise(F.col("p_brand")).alias("symbol"))
    return C.equities_only(named).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("book_imbalance", f"""
WITH b AS (SELECT *, bqty1 + bqty2 AS total_bid_qty, aqty1 + aqty2 - 200 AS total_ask_qty FROM ({sql_book()}))
SELECT seq, rd(CAST(total_bid_qty AS DOUBLE) / nullif(CAST(total_bid_qty AS DOUBLE) + CAST(total_ask_qty AS DOUBLE), 0)
  - CAST(total_ask_qty AS DOUBLE) / nullif(CAST(total_bid_qty AS DOUBLE) + CAST(total_ask_qty AS DOUBLE), 0), 9) AS imbalance FROM b""")
def book_imbalance(spark, sf):
    b = book(spark, sf).withColumns({
        "total_bid_qty": F.col("bqty1") + F.col("bqty2"), "total_ask_qty": F.col("aqty1") + F.col("aqty2") - 200})
    return b.select("seq", rd(C.imbalance(), 9).alias("imbalance"))


@query("date_window", f"""
WITH t AS (SELECT CASE WHEN event_type = 'view' THEN strftime(ts, '%d_%b_%y') ELSE strftime(ts, '%Y-%m-%d') END AS date FROM ({SQL_TICKS}))
SELECT date, count(*) AS n FROM t
WHERE coalesce(try_strptime(date, '%d_%b_%y'), try_strptime(date, '%Y-%m-%d')) BETWEEN DATE '2024-01-08' AND DATE '2024-01-19' GROUP BY 1""")
def date_window(spark, sf):
    named = ticks(spark, sf).select(F.when(F.col("event_type") == "view", F.date_format("ts", "dd_MMM_yy"))
                                    .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    return C.date_window(named, "2024-01-08", "2024-01-19").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("schema_project", f"SELECT ts, symbol, ltp, seq FROM ({sql_book()})")
def schema_project(spark, sf):
    kept, _ = C.validate_columns(C.remove_garbage_columns(book(spark, sf)), ["ts", "symbol", "ltp", "imbalance", "seq"])
    return kept


@query("working_set", f"""
WITH t AS ({SQL_TICKS}) SELECT trade_date, count(*) AS n FROM t
WHERE trade_date IN (SELECT DISTINCT trade_date FROM t ORDER BY 1 LIMIT 20) GROUP BY 1""")
def working_set(spark, sf):
    return C.first_days(ticks(spark, sf), 20).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))


@query("sentinel_filter", f"""
WITH t AS (SELECT CASE event_type WHEN 'error' THEN 'MFticks' WHEN 'signup' THEN '' ELSE symbol END AS symbol FROM ({SQL_TICKS}))
SELECT symbol, count(*) AS n FROM t WHERE symbol <> '' AND symbol NOT IN ('GRAPHITEticks', 'MFticks', 'JSWCEMENTdom_snapshots', 'dom_snapshots') GROUP BY 1""")
def sentinel_filter(spark, sf):
    kind = F.col("event_type")
    mixed = ticks(spark, sf).withColumn(
        "symbol", F.when(kind == "error", "MFticks").when(kind == "signup", "").otherwise(F.col("symbol")))
    return mixed.where(C.has_key() & C.not_sentinel()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- days and tables

_DONE = "ltp > 103.5"


@query("source_days", f"SELECT DISTINCT trade_date FROM ({SQL_TICKS})")
def source_days(spark, sf):
    return S.chronological_days(ticks(spark, sf))


@query("unprocessed_days", f"""
WITH t AS ({SQL_TICKS}) SELECT DISTINCT trade_date FROM t EXCEPT SELECT trade_date FROM t WHERE {_DONE}""")
def unprocessed_days(spark, sf):
    t = ticks(spark, sf)
    return S.unprocessed_days(t, t.where(_DONE))


@query("coverage_audit", f"""
WITH t AS ({SQL_TICKS}),
 a AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM t GROUP BY 1),
 b AS (SELECT trade_date, count(DISTINCT symbol) AS n FROM t WHERE {_DONE} GROUP BY 1)
SELECT trade_date, coalesce(a.n, 0) AS source_symbols, coalesce(b.n, 0) AS labelled_symbols,
  CASE WHEN coalesce(a.n, 0) > 0 AND coalesce(b.n, 0) > 0 THEN 'OK' ELSE 'BLIND' END AS status FROM a FULL JOIN b USING (trade_date)""")
def coverage_audit(spark, sf):
    t = ticks(spark, sf)
    return P.coverage_audit({"source": t, "labelled": t.where(_DONE)})


@query("incremental_append", f"""
WITH t AS ({SQL_TICKS}), stored AS (SELECT * FROM t WHERE {_DONE}),
 fresh AS (SELECT * FROM t WHERE (symbol, trade_date) NOT IN (SELECT (symbol, trade_date) FROM stored)),
 merged AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)
SELECT symbol, trade_date, count(*) AS n FROM merged GROUP BY ALL""")
def incremental_append(spark, sf):
    t = ticks(spark, sf)
    stored = t.where(_DONE)
    both = stored.unionByName(W.new_pairs_only(t, stored))
    return both.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("n"))


@query("union_by_name", f"""
WITH t AS ({SQL_TICKS})
SELECT seq, ltp, trade_qty, CAST(NULL AS VARCHAR) AS event_type FROM t WHERE {TICK_FEED}
UNION ALL SELECT seq, ltp, NULL, event_type FROM t WHERE {BOOK_FEED}""")
def union_by_name(spark, sf):
    t = ticks(spark, sf)
    return W.append_aligned(t.where(TICK_FEED).select("seq", "ltp", "trade_qty"),
                            t.where(BOOK_FEED).select("seq", "ltp", "event_type"))


@query("key_intersection", f"""
WITH t AS ({SQL_TICKS})
SELECT symbol, trade_date FROM t WHERE {TICK_FEED} INTERSECT SELECT symbol, trade_date FROM t WHERE {BOOK_FEED}
INTERSECT SELECT symbol, trade_date FROM t WHERE {_DONE}""")
def key_intersection(spark, sf):
    t = ticks(spark, sf)
    return S.common_keys([t.where(TICK_FEED), t.where(BOOK_FEED), t.where(_DONE)], ["symbol", "trade_date"])


def _place(spark):
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


_READ = ["symbol", "trade_date", "ts", "ltp", "trade_qty"]
_SQL_LAST = f"(SELECT max(trade_date) FROM ({SQL_TICKS}))"


@query("day_files", f"""SELECT DISTINCT 'ticks' AS kind, trade_date FROM ({SQL_TICKS}) WHERE trade_date > {_SQL_LAST} - INTERVAL 5 DAY""")
def day_files(spark, sf):
    """Day-level files by their names, beside files of other names, which are passed over."""
    t, place = ticks(spark, sf).select(*_READ), _place(spark)
    last = t.agg(F.max("trade_date")).first()[0]
    name = F.date_format("trade_date", "'ticks_year='yyyy'_month='MM'_day='dd'_ticks.parquet'")
    days = t.where(F.datediff(F.lit(last), "trade_date") < 5).withColumn("file", name)
    W.write_named_files(days.unionByName(days.where(F.col("trade_date") == F.lit(last)).withColumn("file", F.lit("notes.parquet"))), place, "file")
    return S.discover_day_files(spark, place).select("kind", "trade_date")


@query("mixed_files", f"""WITH t AS (SELECT * FROM ({SQL_TICKS}) WHERE trade_date > {_SQL_LAST} - INTERVAL 3 DAY AND symbol IN ('S0', 'S1'))
SELECT symbol, strftime(trade_date, '%d_%b_%y') AS date_str, count(*) AS rows, rd(sum(ltp), 4) AS ltp_sum, rd(sum(CASE WHEN symbol = 'S0' THEN ltp + 1 ELSE ltp END), 4) AS close_sum FROM t GROUP BY ALL""")
def mixed_files(spark, sf):
    """Files of differing schemas with the day in their names, a damaged and an empty one among them."""
    t, place = ticks(spark, sf).select("symbol", "trade_date", "ltp"), _place(spark)
    last = t.agg(F.max("trade_date")).first()[0]
    some = t.where((F.datediff(F.lit(last), "trade_date") < 3) & F.col("symbol").isin("S0", "S1")).withColumn("file", F.concat(slug("symbol", "trade_date"), F.lit(".parquet")))
    W.write_named_files(some.where("symbol = 'S0'").withColumn("close_price", F.col("ltp") + 1), f"{place}/a", "file")
    W.write_named_files(some.where("symbol = 'S1'"), f"{place}/b", "file")
    some.limit(1).select(F.rpad(F.lit("no parquet"), 400, ".").alias("value")).coalesce(1).write.text(f"{place}/c/damaged.parquet")
    read = S.read_tolerant(spark, f"{place}/*", ["symbol", "date_str", "ltp", "close_price"], {"close_price": "ltp"}, recursive=True)
    return read.groupBy("symbol", "date_str").agg(F.count(F.lit(1)).alias("rows"), rd(F.sum("ltp"), 4).alias("ltp_sum"), rd(F.sum("close_price"), 4).alias("close_sum"))


@query("day_load", f"""WITH t AS ({SQL_TICKS}), d AS (SELECT DISTINCT trade_date FROM t ORDER BY 1 DESC LIMIT 2)
SELECT trade_date, symbol, count(*) AS rows, rd(sum(ltp), 4) AS close_sum FROM t JOIN d USING (trade_date) GROUP BY ALL""")
def day_load(spark, sf):
    """The last two days of a table partitioned by day, two columns of it, closes taken from the last price."""
    t, place = ticks(spark, sf).select(*_READ), _place(spark)
    W.write_table(t, place)
    days = [str(r.trade_date) for r in t.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(2).collect()]
    out = S.load_days(spark.read.parquet(place).withColumn("close_price", F.lit(None).cast("double")), days, ["symbol", "trade_date", "close_price", "ltp"], ["close_price"])
    return out.groupBy("trade_date", "symbol").agg(F.count(F.lit(1)).alias("rows"), rd(F.sum("close_price"), 4).alias("close_sum"))


@query("symbol_day_split", f"""SELECT symbol, trade_date, count(*) AS rows, sum(trade_qty) AS qty
FROM (SELECT *, bool_or({_DONE}) OVER (PARTITION BY symbol, trade_date) AS stored FROM ({SQL_TICKS})) WHERE symbol <> 'S3' AND ({_DONE} OR NOT stored) GROUP BY ALL""")
def symbol_day_split(spark, sf):
    """Day-level rows dealt to (day, symbol) folders; sentinel symbols are dropped, pairs that exist are kept as they are."""
    sentinel = F.when(F.col("symbol") == "S3", F.lit("dom_snapshots")).otherwise(F.col("symbol"))
    t, place = ticks(spark, sf).select(*_READ).withColumn("symbol", sentinel), _place(spark)
    first, stored = t.where(_DONE), lambda: spark.read.schema(t.schema).parquet(place)  # there may be no file yet
    W.split_day(first, place, force=True)
    W.split_day(t.withColumn("trade_qty", F.when(F.expr(_DONE), F.lit(-1)).otherwise(F.col("trade_qty")).cast(t.schema["trade_qty"].dataType)), place, existing=stored())
    return stored().groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("trade_qty").cast("decimal(38,0)").alias("qty"))


@query("replaced_day", f"""SELECT trade_date, count(*) AS rows, sum(CASE WHEN trade_date = {_SQL_LAST} THEN 2 * trade_qty ELSE trade_qty END) AS qty FROM ({SQL_TICKS}) GROUP BY 1""")
def replaced_day(spark, sf):
    """One day of a stored table written again, with its quantities doubled; the other days stay."""
    t, place = ticks(spark, sf).select(*_READ), _place(spark)
    W.write_table(t, place)
    last = t.agg(F.max("trade_date")).first()[0]
    W.replace_days(t.where(F.col("trade_date") == F.lit(last)).withColumn("trade_qty", F.col("trade_qty") * 2), place)
    return spark.read.parquet(place).groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("trade_qty").cast("decimal(38,0)").alias("qty"))


@query("result_formats", f"""SELECT format, symbol, count(*) AS rows, sum(trade_qty) AS qty FROM ({SQL_TICKS}) CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS format) GROUP BY ALL""")
def result_formats(spark, sf):
    """The same rows through each of the result writers and back."""
    t, place = ticks(spark, sf).select("symbol", "trade_qty"), _place(spark)
    parts = []
    for fmt in ("parquet", "csv", "json"):
        W.write_results(t, f"{place}/{fmt}", fmt)
        parts.append(spark.read.schema(t.schema).option("header", "true").format(fmt).load(f"{place}/{fmt}").withColumn("format", F.lit(fmt)))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("format", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("trade_qty").cast("decimal(38,0)").alias("qty"))


@query("root_priority", f"""
WITH t AS (SELECT *, {_SLUG} AS file_name FROM ({SQL_TICKS})),
 f AS (SELECT file_name, 0 AS root_no, count(*) AS n FROM t WHERE {_DONE} GROUP BY 1 UNION ALL SELECT file_name, 1, count(*) FROM t GROUP BY 1)
SELECT file_name, CAST(root_no AS INTEGER) AS root_no, n FROM f WHERE root_no = (SELECT min(root_no) FROM f g WHERE g.file_name = f.file_name)""")
def root_priority(spark, sf):
    t = ticks(spark, sf).withColumn("file_name", slug("symbol", "trade_date"))
    listing = lambda df, i: df.groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).withColumn("root_no", F.lit(i))
    return S.first_root_wins(listing(t.where(_DONE), 0).unionByName(listing(t, 1)))


@query("whitelist", """
SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part WHERE p_size % 2 = 0 AND p_type = 'STANDARD'
  AND upper(trim(p_brand)) IN (SELECT upper(trim(p_brand)) FROM part WHERE p_retailprice > 950)""")
def whitelist(spark, sf):
    part = table(spark, sf, "part")
    master = part.select(
        F.when(F.col("p_size") % 2 == 0, " nse ").otherwise("BSE").alias("exch"), F.lit("e").alias("seg"),
        F.when(F.col("p_type").contains("STANDARD"), "EQ").otherwise("BE").alias("series"),
        F.concat(F.lit(" "), F.lower("p_brand")).alias("symbol"))
    watch = part.where("p_retailprice > 950").select(F.col("p_brand").alias("symbol"))
    return S.whitelist(master, watch, {"exchange": "exch", "segment": "seg", "series": "series", "symbol": "symbol"})


@query("unified_split", f"""
WITH b AS (SELECT *, bqty1 + bqty2 + bqty3 + bqty4 + bqty5 AS tb, aqty1 + aqty2 + aqty3 + aqty4 + aqty5 AS ta FROM ({sql_book()}))
SELECT symbol, count(*) AS snapshots, rd(sum(CAST(tb AS DOUBLE) / (tb + ta) - CAST(ta AS DOUBLE) / (tb + ta)), 4) AS imbalance_sum
FROM b WHERE symbol IN (SELECT symbol FROM ({SQL_TICKS}) WHERE {_DONE}) GROUP BY 1""")
def unified_split(spark, sf):
    b = book(spark, sf).withColumns({
        "total_bid_qty": sum((F.col(f"bqty{i}") for i in range(2, 6)), F.col("bqty1")),
        "total_ask_qty": sum((F.col(f"aqty{i}") for i in range(2, 6)), F.col("aqty1"))})
    listed = ticks(spark, sf).where(_DONE).select("symbol")
    return W.unified_book(b, listed).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("snapshots"), rd(F.sum("imbalance"), 4).alias("imbalance_sum"))


# --------------------------------------------------------------------------- trades

def _lagged(flat):
    lag = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in
                    ["ltp"] + [f"{s}{i}" for s in ("bid", "bqty", "ask", "aqty") for i in range(1, 6)])
    return (f"lagged AS (SELECT *, {lag} FROM ({sql_book(flat)}) "
            "WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY ts, seq))")


def _sql_trades(flat=False):
    parts = []
    for i in range(1, 6):
        for px, qty, side, cmp, mv in (("ask", "aqty", "BUY", "<", "ask1 > p_ask1"), ("bid", "bqty", "SELL", ">", "bid1 < p_bid1")):
            moved = f"{mv} AND p_{px}1 > 0"
            head = "SELECT symbol, trade_date, ts, seq,"
            parts.append(f"{head} p_{px}{i} AS trade_price, p_{qty}{i} AS trade_qty, '{side}' AS direction, 1 AS priority, {i} AS level_idx "
                         f"FROM lagged WHERE p_{px}{i} {cmp} {px}1 AND p_{px}{i} > 0 AND p_{qty}{i} > 0 AND {moved}")
            parts.append(f"{head} {px}1, p_{qty}{i} - {qty}1, '{side}', 2, {i} "
                         f"FROM lagged WHERE p_{px}{i} = {px}1 AND p_{qty}{i} - {qty}1 > 0 AND {moved}")
    for px, qty, side in (("ask", "aqty", "BUY"), ("bid", "bqty", "SELL")):
        parts.append(f"SELECT symbol, trade_date, ts, seq, p_{px}1, p_{qty}1 - {qty}1, '{side}', 1, 1 "
                     f"FROM lagged WHERE {px}1 = p_{px}1 AND p_{px}1 > 0 AND p_{qty}1 - {qty}1 > 0")
    return f"""{_lagged(flat)}, found AS ({' UNION ALL '.join(parts)}),
 trades AS (SELECT * FROM found UNION ALL
  SELECT symbol, trade_date, ts, seq, ltp, 1, CASE WHEN p_ask1 > 0 AND p_bid1 > 0 THEN
    CASE WHEN ltp >= (p_ask1 + p_bid1) / 2.0 THEN 'BUY' ELSE 'SELL' END ELSE 'BUY' END, 3, 1
  FROM lagged l WHERE p_ltp IS NOT NULL AND ltp <> p_ltp AND ltp > 0
    AND NOT EXISTS (SELECT 1 FROM found f WHERE f.symbol = l.symbol AND f.trade_date = l.trade_date AND f.ts = l.ts))"""


SQL_TRADES = _sql_trades()
_TRADE_OUT = ("SELECT symbol, trade_date, ts, seq, trade_price, CAST(trade_qty AS BIGINT) AS trade_qty, direction, "
              "CAST(priority AS INTEGER) AS priority, CAST(level_idx AS INTEGER) AS level_idx FROM trades")


@query("infer_trades", f"WITH {SQL_TRADES} {_TRADE_OUT}")
def infer_trades(spark, sf):
    return naive_ts(T.infer_trades(book(spark, sf)))


@query("infer_trades_fallback", f"WITH {_sql_trades(True)} {_TRADE_OUT}")
def infer_trades_fallback(spark, sf):
    return naive_ts(T.infer_trades(flat_book(spark, sf)))


@query("trade_stats", f"""WITH {SQL_TRADES}
SELECT symbol, trade_date, count(*) AS trades, count(*) FILTER (WHERE direction = 'BUY') AS buys, count(*) FILTER (WHERE direction <> 'BUY') AS sells,
  rd(count(*) FILTER (WHERE direction = 'BUY') * 100.0 / count(*), 6) AS buy_pct, CAST(sum(trade_qty) AS BIGINT) AS volume,
  rd(avg(trade_qty), 6) AS mean_qty, max(trade_qty) AS max_qty, min(trade_price) AS min_price, max(trade_price) AS max_price
FROM trades GROUP BY ALL""")
def trade_stats(spark, sf):
    return rounded(T.trade_stats(T.infer_trades(book(spark, sf))), "buy_pct", "mean_qty")


@query("extract_trades", f"""
SELECT symbol, trade_date, ts, seq, ltp AS trade_price, trade_qty, aggressor AS direction FROM ({SQL_TICKS}) WHERE trade_qty > 0""")
def extract_trades(spark, sf):
    return C.extract_trades(ticks(spark, sf))


# --------------------------------------------------------------------------- bars

SQL_BOOK_BARS = f"""book_bars AS (
  SELECT symbol, trade_date, {SQL_BAR} AS ts, arg_min(ltp, seq) AS open_price, arg_max(ltp, seq) AS close_price, avg(ltp) AS ltp,
    {', '.join(f'avg({s}{i}) AS {s}{i}' for s in ('bid', 'bqty', 'ask', 'aqty') for i in range(1, 6))},
    avg(bqty1) + avg(bqty2) + avg(bqty3) + avg(bqty4) + avg(bqty5) AS total_bid_qty,
    avg(aqty1) + avg(aqty2) + avg(aqty3) + avg(aqty4) + avg(aqty5) AS total_ask_qty
  FROM ({sql_book()}) GROUP BY ALL)"""
_LEVELS = [f"{s}{i}" for s in ("bid", "bqty", "ask", "aqty") for i in range(1, 6)]
_BOOK_BAR_COLS = ["ltp", *_LEVELS, "total_bid_qty", "total_ask_qty"]


@query("book_bars", f"""WITH {SQL_BOOK_BARS}
SELECT symbol, trade_date, ts, open_price, close_price, {', '.join(f'rd({c}, 5) AS {c}' for c in _BOOK_BAR_COLS)} FROM book_bars""")
def book_bars(spark, sf):
    return rounded(naive_ts(B.book_bars(book(spark, sf), bar=BAR)), *_BOOK_BAR_COLS, places=5)


def sql_trade_bars(source="trades", large="0", bar=SQL_BAR, name="trade_bars"):
    return f"""{name} AS (SELECT symbol, trade_date, {bar} AS ts,
  CAST(sum(CASE WHEN direction = 'BUY' THEN trade_qty ELSE 0 END) AS BIGINT) AS buy_vol_1m,
  CAST(sum(CASE WHEN direction = 'SELL' THEN trade_qty ELSE 0 END) AS BIGINT) AS sell_vol_1m,
  CAST(sum(trade_qty) AS BIGINT) AS volume_1m, count(*) AS trade_count_1m, CAST(sum({large}) AS BIGINT) AS large_trade_count_1m,
  sum(trade_price * trade_qty) AS trade_value_1m,
  CASE WHEN sum(trade_qty) > 0 THEN sum(trade_price * trade_qty) / sum(trade_qty) ELSE 0.0 END AS vwap_1m
  FROM {source} GROUP BY ALL)"""


_TB = ("SELECT symbol, trade_date, ts, buy_vol_1m, sell_vol_1m, volume_1m, trade_count_1m, large_trade_count_1m, "
       "rd(trade_value_1m, 4) AS trade_value_1m, rd(vwap_1m, 8) AS vwap_1m FROM ")


def _tb(df):
    return naive_ts(df.withColumns({"trade_value_1m": rd("trade_value_1m", 4), "vwap_1m": rd("vwap_1m", 8)}))


# running median of the last 10,000 trades, refreshed on the schedule of the operator
SQL_LARGE = """flagged AS (
  SELECT *, CASE WHEN lim IS NOT NULL AND trade_qty > lim THEN 1 ELSE 0 END AS is_large FROM (
    SELECT *, last_value(fresh IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY rn ROWS UNBOUNDED PRECEDING) AS lim FROM (
      SELECT *, CASE WHEN k >= 3 AND ((k <= 50 AND k % 5 = 0) OR (k > 50 AND k % 50 = 0)) THEN 10 * med END AS fresh FROM (
        SELECT *, least(rn, 10000) AS k, quantile_cont(trade_qty, 0.5) OVER (PARTITION BY symbol, trade_date ORDER BY rn ROWS 9999 PRECEDING) AS med FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts, seq, priority, level_idx, direction) AS rn FROM trades)))))"""


@query("trade_bars", f"WITH {SQL_TRADES}, {sql_trade_bars()} {_TB} trade_bars")
def trade_bars(spark, sf):
    return _tb(B.trade_bars(T.infer_trades(book(spark, sf)), bar=BAR))


@query("trade_bars_dense", f"""WITH trades AS (SELECT symbol, trade_date, ts, ltp AS trade_price, trade_qty, aggressor AS direction FROM ({SQL_TICKS})),
 med AS (SELECT symbol, trade_date, quantile_cont(trade_qty, 0.5) AS m FROM trades GROUP BY ALL),
 {sql_trade_bars('(SELECT t.*, trade_qty > 2 * m AS big FROM trades t JOIN med USING (symbol, trade_date))', 'CAST(big AS INTEGER)')},
 grid AS (SELECT symbol, trade_date, unnest(generate_series(lo, hi, INTERVAL '15 minutes')) AS ts
  FROM (SELECT symbol, trade_date, min(ts) AS lo, max(ts) AS hi FROM trade_bars GROUP BY ALL))
SELECT symbol, trade_date, ts, {', '.join(f'coalesce({c}, 0) AS {c}' for c in B.TRADE_SUMS)},
  rd(coalesce(trade_value_1m, 0.0), 4) AS trade_value_1m, rd(coalesce(vwap_1m, 0.0), 8) AS vwap_1m
FROM grid LEFT JOIN trade_bars USING (symbol, trade_date, ts)""")
def trade_bars_dense(spark, sf):
    return _tb(B.dense_trade_bars(C.extract_trades(ticks(spark, sf)), bar=BAR, times=2.0))


@query("ohlc_bars", f"""
SELECT symbol, trade_date, {SQL_BAR} AS ts, arg_min(ltp, seq) AS open_price, max(ltp) AS high_price, min(ltp) AS low_price,
  arg_max(ltp, seq) AS close_price, rd(avg(ltp), 6) AS ltp FROM ({SQL_TICKS}) GROUP BY ALL""")
def ohlc_bars(spark, sf):
    return rounded(naive_ts(B.ohlc_bars(ticks(spark, sf), bar=BAR)), "ltp")


@query("bars_with_trades", f"""WITH {SQL_TRADES}, {SQL_BOOK_BARS}, {sql_trade_bars()}
SELECT symbol, trade_date, ts, open_price, close_price, rd(ltp, 5) AS ltp,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in B.TRADE_SUMS)}, rd(coalesce(vwap_1m, 0.0), 6) AS vwap_1m
FROM book_bars LEFT JOIN trade_bars USING (symbol, trade_date, ts)""")
def bars_with_trades(spark, sf):
    b = book(spark, sf)
    out = B.bars_with_trades(B.book_bars(b, bar=BAR), B.trade_bars(T.infer_trades(b), bar=BAR))
    return naive_ts(out.select("symbol", "trade_date", "ts", "open_price", "close_price", rd("ltp", 5).alias("ltp"),
                               *B.TRADE_SUMS, rd("vwap_1m", 6).alias("vwap_1m")))


@query("ohlc_enriched", f"""WITH {SQL_BOOK_BARS},
 o AS (SELECT symbol, trade_date, {SQL_BAR} AS ts, arg_min(ltp, seq) AS o, max(ltp) AS h, min(ltp) AS l, arg_max(ltp, seq) AS c
       FROM ({SQL_TICKS}) WHERE {TICK_FEED} GROUP BY ALL)
SELECT symbol, trade_date, ts, rd(coalesce(o, ltp), 5) AS open_price, rd(coalesce(h, ltp), 5) AS high_price,
  rd(coalesce(l, ltp), 5) AS low_price, rd(coalesce(c, ltp), 5) AS close_price FROM book_bars LEFT JOIN o USING (symbol, trade_date, ts)""")
def ohlc_enriched(spark, sf):
    true_prices = B.ohlc_bars(ticks(spark, sf).where(TICK_FEED), bar=BAR)
    out = B.enrich_with_ohlc(B.book_bars(book(spark, sf), bar=BAR), true_prices)
    prices = ["open_price", "high_price", "low_price", "close_price"]
    return naive_ts(rounded(out.select("symbol", "trade_date", "ts", *prices), *prices, places=5))


@query("lineitem_trade_bars", f"""WITH trades AS ({SQL_LINEITEM}), {sql_trade_bars(bar="date_trunc('day', ts)")} {_TB} trade_bars""")
def lineitem_trade_bars(spark, sf):
    out = _tb(B.trade_bars(lineitem_trades(spark, sf), bar="1 day"))
    return out


@query("large_trade_flag", f"""WITH {SQL_TRADES}, {SQL_LARGE}
SELECT symbol, trade_date, ts, seq, trade_price, CAST(trade_qty AS BIGINT) AS trade_qty, direction, CAST(level_idx AS INTEGER) AS level_idx,
  CAST(priority AS INTEGER) AS priority, CAST(is_large AS INTEGER) AS is_large FROM flagged""")
def large_flag(spark, sf):
    order = ("ts", "seq", "priority", "level_idx", "direction")
    return naive_ts(large_trade_flag(T.infer_trades(book(spark, sf)), order=order))


@query("bar_count_pivot", f"""WITH n AS (SELECT symbol, strftime(trade_date, 'd%Y_%m_%d') AS day, count(DISTINCT {SQL_BAR}) AS bars FROM ({SQL_TICKS}) GROUP BY ALL)
SELECT symbol, day, CAST(coalesce(bars, 0) AS BIGINT) AS bars FROM (SELECT DISTINCT symbol FROM n) CROSS JOIN (SELECT DISTINCT day FROM n) LEFT JOIN n USING (symbol, day)""")
def bar_count_pivot(spark, sf):
    """The pivot's cells as rows: its columns are the days of the data, which no fixed SQL can name."""
    return P.bar_count_pivot(ticks(spark, sf), bar=BAR).unpivot("symbol", None, "day", "bars")
