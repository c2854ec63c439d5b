"""Readers: day files with facts in their names, several roots, tolerant projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_FILE = r"^(doms|ticks|dom_snapshots)_year=(\d{4})_month=(\d{2})_day=(\d{2})_(doms|ticks|dom_snapshots)\.parquet$"
SLUG_DAY = r"_(\d{1,2}_[A-Z][a-z]{2}_\d{2})\.parquet$"
MIN_FILE_BYTES = 100


def file_name(column: str = "path"):
    return F.element_at(F.split(F.col(column), "/"), -1)


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.parquet") -> DataFrame:
    """path, file_name, bytes, root_no of every file; contents are not read."""
    parts = []
    for i, root in enumerate(roots):
        files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(root))
        parts.append(files.select("path", F.col("length").alias("bytes"), F.lit(i).alias("root_no")))
    return reduce(DataFrame.unionByName, parts).withColumn("file_name", file_name())


def discover_day_files(spark: SparkSession, root: str) -> DataFrame:
    """path, kind (doms / ticks), trade_date of every day-level file."""
    names = list_files(spark, [root])
    g = lambda i: F.regexp_extract("file_name", DAY_FILE, i)
    return names.where(F.col("file_name").rlike(DAY_FILE)).select(
        "path", F.when(g(1).contains("dom"), "doms").otherwise("ticks").alias("kind"),
        F.make_date(g(2).cast("int"), g(3).cast("int"), g(4).cast("int")).alias("trade_date"))


def first_root_wins(files: DataFrame, name: str = "file_name", priority: str = "root_no") -> DataFrame:
    """One file per name: the one from the first root that has it."""
    best = files.groupBy(name).agg(F.min(priority).alias(priority))
    return files.join(best, [name, priority], "left_semi")


def usable_files(files: DataFrame, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    return files.where(F.col("bytes") > min_bytes)


def read_tolerant(spark: SparkSession, path: str, columns: list[str] | None = None,
                  defaults: dict[str, str] | None = None, skip_bad: bool = True, recursive: bool = False) -> DataFrame:
    """Parquet with differing schemas: columns united by name, the day taken from the file name, an absent
    column filled from another (close_price <- ltp).

    ``skip_bad``: damaged and near-empty files are left out, and ``bad_files`` names them; otherwise the
    read fails on the first one.
    """
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", str(skip_bad).lower()).option("recursiveFileLookup", str(recursive).lower())
    df = reader.parquet(path)
    if skip_bad:
        df = df.where(F.col("_metadata.file_size") > MIN_FILE_BYTES)
    return complete(df.withColumn("date_str", F.regexp_extract(F.col("_metadata.file_name"), SLUG_DAY, 1)), columns, defaults)


def bad_files(spark: SparkSession, path: str, min_bytes: int = MIN_FILE_BYTES) -> DataFrame:
    """path, bytes, reason of the files that a tolerant read leaves out: near-empty ones, and those that gave no row."""
    listed = list_files(spark, [path]).select("path", "bytes")
    seen = (spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(path)
            .select(F.col("_metadata.file_path").alias("path")).distinct().withColumn("seen", F.lit(True)))
    reason = F.when(F.col("bytes") <= min_bytes, "near-empty").when(F.col("seen").isNull(), "unreadable or without rows")
    return listed.join(seen, "path", "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("seen")


def complete(df: DataFrame, columns: list[str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    for name, source in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(name, source) if name in df.columns else F.col(source))
    if columns is None:
        return df
    return df.select(*[c for c in columns if c in df.columns])


def load_days(bars: DataFrame, days: list[str] | None, columns: list[str], required: list[str]) -> DataFrame:
    """Column-pruned bars of the given days; rows lacking a required value are dropped.

    The day predicate reaches the scan as a partition filter when the table is partitioned by it.
    """
    df = bars if days is None else bars.where(F.col("trade_date").isin([F.lit(d).cast("date") for d in days]))
    df = complete(df, columns, {"close_price": "ltp"} if "close_price" in columns else None)
    return df.dropna(subset=[c for c in required if c in df.columns])


def chronological_days(df: DataFrame, day: str = "trade_date") -> DataFrame:
    return df.select(day).distinct().orderBy(day)


def unprocessed_days(source: DataFrame, done: DataFrame, day: str = "trade_date") -> DataFrame:
    """Source days with no output yet."""
    return source.select(day).distinct().join(done.select(day).distinct(), day, "left_anti")


def common_keys(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys present in every table."""
    return reduce(lambda a, b: a.intersect(b), [t.select(*keys) for t in tables])


# Columns of the public instrument master.
MASTER_COLUMNS = {
    "exchange": "SEM_EXM_EXCH_ID",
    "segment": "SEM_SEGMENT",
    "series": "SEM_SERIES",
    "symbol": "SEM_TRADING_SYMBOL",
}


def whitelist(master: DataFrame, watch: DataFrame | None = None,
              columns: dict[str, str] | None = None) -> DataFrame:
    """Tradable symbols of an instrument master (exchange NSE, segment E, series EQ), trimmed and
    upper case, optionally cut to a watch list."""
    c = {**MASTER_COLUMNS, **(columns or {})}
    clean = lambda name: F.upper(F.trim(F.col(name).cast("string")))
    listed = ((clean(c["exchange"]) == "NSE") & (clean(c["segment"]) == "E") & (clean(c["series"]) == "EQ"))
    out = master.where(listed).select(clean(c["symbol"]).alias("symbol")).where("symbol <> ''").distinct()
    if watch is not None:
        out = out.join(watch.select(clean("symbol").alias("symbol")).distinct(), "symbol", "left_semi")
    return out
