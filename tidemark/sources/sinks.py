"""Writers: partitioned tables, day replacement, incremental append, split and export."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.clean import has_key, imbalance, not_sentinel, within_symbols

# Column order of the two projections of a unified feed.
UNIFIED_BOOK = (
    ["ts", "symbol", "ltp", "total_bid_qty", "total_ask_qty"]
    + [c for i in range(1, 6) for c in (f"bid{i}", f"bqty{i}")]
    + [c for i in range(1, 6) for c in (f"ask{i}", f"aqty{i}")]
)
UNIFIED_TICK = ["ts", "symbol", "ltp", "volume", "oi", "aggressor", "trade_qty",
                "bid1", "bqty1", "ask1", "aqty1", "cum_delta"]


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("trade_date",), mode: str = "overwrite",
                spread: int | None = None, sort: tuple[str, ...] = ("symbol", "ts")) -> None:
    """Partitioned parquet.  Overwrite replaces only the partitions present in ``df``.

    Rows of one partition value are spread over ``spread`` writers by a salt on the symbol and
    the hour, so a day (or one hot symbol in it) is not written by a single task.  By default one in
    25 of the session's shuffle partitions, so that the number follows the cluster.
    """
    spread = spread or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 25)
    cols = [F.col(c) for c in by]
    if "symbol" in df.columns and "ts" in df.columns:
        salt = F.pmod(F.xxhash64("symbol", F.date_trunc("hour", F.col("ts").cast("timestamp"))), F.lit(spread))
        df = df.repartition(*cols, salt)
    (df.sortWithinPartitions(*by, *[c for c in sort if c in df.columns and c not in by])
       .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def replace_days(df: DataFrame, path: str) -> None:
    """Replace the days present in ``df``; all other days stay as they are."""
    write_table(df, path, ("trade_date",), "overwrite")


def clean_to_table(raw: DataFrame, path: str, clean: Callable[..., DataFrame], **options) -> dict[str, int]:
    """Write the cleaned rows of a feed by day and return raw_rows and clean_rows, counted by the job that writes.

    ``clean`` is ``clean_book`` or ``clean_ticks``.  Cleaning is narrow and so is this write: no shuffle, whose empty
    result adaptive execution would drop together with the counts.  Each task writes the days that it reads.
    """
    counts = Observation()
    (clean(raw, observe=counts, **options).sortWithinPartitions("trade_date", "symbol", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date").parquet(path))
    return {name: counts.get[name] for name in ("raw_rows", "clean_rows")}


def new_pairs_only(incoming: DataFrame, existing: DataFrame,
                   keys: tuple[str, ...] = ("symbol", "trade_date")) -> DataFrame:
    """Rows whose (symbol, day) is not stored yet."""
    return incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def append_aligned(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side becomes NULL there."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def incremental_append(incoming: DataFrame, existing: DataFrame, path: str) -> None:
    write_table(new_pairs_only(incoming, existing), path, mode="append")


def split_day(df: DataFrame, path: str, force: bool = False, existing: DataFrame | None = None) -> dict[str, int]:
    """Write a day-level table per (day, symbol); sentinel and empty symbols are counted and dropped.

    Counts are one aggregate over the key columns.  (An observation inside the write would be
    lost when adaptive execution finds that nothing is left to write.)  Without ``force`` pairs
    that already exist are skipped.
    """
    sentinel = ~F.coalesce(not_sentinel(), F.lit(True))
    stats = df.select("symbol", "ts").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(sentinel).alias("sentinel_rows"),
        F.count_if(~F.coalesce(has_key(), F.lit(False))).alias("keyless_rows")).first().asDict()
    kept = df.where(has_key() & not_sentinel())
    if existing is not None and not force:
        kept = new_pairs_only(kept, existing)
    write_table(kept, path, ("trade_date", "symbol"), "overwrite" if force or existing is None else "append")
    return stats


def unified_book(unified: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Book projection of a unified feed with imbalance, listed symbols only."""
    df = unified if symbols is None else within_symbols(unified, symbols)
    return df.select(*UNIFIED_BOOK, *_extra(df), imbalance().alias("imbalance"))


def unified_ticks(unified: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    df = unified if symbols is None else within_symbols(unified, symbols)
    return df.select(*[c for c in UNIFIED_TICK if c in df.columns], *_extra(df))


def _extra(df: DataFrame) -> list[str]:
    return [c for c in ("trade_date", "seq") if c in df.columns]


def write_named_files(df: DataFrame, path: str, name: str) -> None:
    """One parquet file for each value of ``name``, which is its file name, for tools that read names: rows of a file meet in
    one writer, and each is moved to its name when all are written."""
    spark = df.sparkSession
    df.repartition(name).write.mode("overwrite").partitionBy(name).parquet(f"{path}/_parts")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(place(f"{path}/_parts")):  # one per file
        label, _, value = folder.getPath().getName().partition("=")
        if label == name:
            for part in files.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), place(f"{path}/{unquote(value)}"))
    files.delete(place(f"{path}/_parts"), True)


def write_by_pair(strategy_rows: DataFrame, summary: DataFrame, path: str) -> None:
    """One table partitioned by threshold pair, and its summary next to it."""
    strategy_rows.write.mode("overwrite").partitionBy("pair").parquet(f"{path}/pairs")
    summary.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/summary")


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "csv": writer.option("header", "true").csv, "json": writer.json}[fmt](path)
