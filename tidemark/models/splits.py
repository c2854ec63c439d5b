"""Fold tables and purging.

A split is a small table (fold, trade_date, role); bars meet it through a join on the day, one
fold at a time, so the bars are never multiplied by the number of folds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import md5_fold


def hash_folds(df: DataFrame, key: str = "symbol", folds: int = 5) -> DataFrame:
    """fold from the digest of the key: stable for new symbols, no table to keep."""
    return df.withColumn("fold", md5_fold(key, folds))


def seeded_folds(df: DataFrame, key: str = "symbol", folds: int = 5, seed: int = 42) -> DataFrame:
    """key, fold: keys in seeded hash order, dealt round-robin, so folds differ by one key at most.

    The window runs over the distinct keys (one row per symbol).
    """
    w = Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.select(key).distinct().withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def mapped_folds(df: DataFrame, fold_map: DataFrame, key: str = "symbol", folds: int = 5) -> DataFrame:
    """fold from a stored map; keys the map does not know take the hash fold."""
    known = fold_map.select(F.col(key), F.col("fold").alias("_known"))
    return df.join(known, key, "left").withColumn("fold", F.coalesce("_known", md5_fold(key, folds))).drop("_known")


def save_fold_map(fold_map: DataFrame, path: str, key: str = "symbol") -> None:
    """The map as one JSON object, key to fold (one entry per symbol)."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col("fold").cast("int").alias("fold"))))
    fold_map.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_fold_map(spark: SparkSession, path: str, key: str = "symbol") -> DataFrame:
    """key, fold from a stored JSON object; keys that carry a day behind ``_`` stand for their symbol."""
    text = spark.read.option("wholetext", "true").text(path).where("trim(value) <> ''")
    pairs = text.select(F.explode(F.from_json("value", "map<string,int>")).alias(key, "fold"))
    base = F.upper(F.split(key, "_")[0])
    return pairs.select(base.alias(key), "fold", F.col(key).alias("_name")).groupBy(key).agg(F.max_by("fold", "_name").alias("fold"))


def check_folds(assigned: DataFrame, key: str = "symbol", folds: int = 5) -> DataFrame:
    """rule, passed: every key in one fold, every fold used, sizes within one of each other."""
    per_key = assigned.groupBy(key).agg(F.countDistinct("fold").alias("n"), F.min("fold").alias("fold"))
    sizes = per_key.groupBy("fold").agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most"))
    one = sizes.agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("used"),
                    (F.max("keys") - F.min("keys")).alias("gap"))
    rules = [("one_fold_per_key", F.col("most") == 1), ("all_folds_used", F.col("used") == folds),
             ("balanced", F.col("gap") <= 1)]
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), ok.alias("passed")) for n, ok in rules])).alias("r")).select("r.*")


def _calendar(days: DataFrame, day: str) -> DataFrame:
    """One row per trading day, numbered."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    return days.select(day).distinct().withColumn("no", F.row_number().over(w))


def block_folds(days: DataFrame, blocks: int = 5, day: str = "trade_date") -> DataFrame:
    """fold, day, role: contiguous blocks (the first ones a day longer); days next to the validation
    block are purged."""
    w = Window.partitionBy(F.lit(0)).orderBy("no")
    calendar = _calendar(days, day).withColumn("block", F.ntile(blocks).over(w))
    edges = calendar.groupBy(F.col("block").alias("fold")).agg(F.min("no").alias("lo"), F.max("no").alias("hi"))
    no = F.col("no")
    role = (F.when(no.between(F.col("lo"), F.col("hi")), "val")
            .when((no == F.col("lo") - 1) | (no == F.col("hi") + 1), "purged").otherwise("train"))
    # blocks x days rows: the calendar is the only thing multiplied
    return calendar.crossJoin(F.broadcast(edges)).select(F.col("fold").cast("bigint").alias("fold"), day, role.alias("role"))


def walk_forward_folds(days: DataFrame, min_train: int = 5, day: str = "trade_date") -> DataFrame:
    """fold, day, role: each day after the first ``min_train`` is validated on all days before it."""
    calendar = _calendar(days, day)
    vals = calendar.where(F.col("no") > min_train).select(
        (F.col("no") - min_train).cast("bigint").alias("fold"), F.col("no").alias("val_no"))
    pairs = calendar.join(F.broadcast(vals), F.col("no") <= F.col("val_no"))
    return pairs.select("fold", day, F.when(F.col("no") == F.col("val_no"), "val").otherwise("train").alias("role"))


def validation_starts(bars: DataFrame, folds: DataFrame, day: str = "trade_date") -> DataFrame:
    """fold, val_start: first bar time of each fold's validation days."""
    first = bars.groupBy(day).agg(F.min(F.col("ts").cast("timestamp")).alias("t"))
    return folds.where("role = 'val'").join(first, day).groupBy("fold").agg(F.min("t").alias("val_start"))


def split_fold(bars: DataFrame, folds: DataFrame, fold: int, horizon_min: int | None = 60,
               day: str = "trade_date") -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one fold.  With a horizon, training rows whose label reaches into the
    validation period (ts >= first validation time - horizon) are removed; rows after it are kept
    only by block splits, which pass horizon None because whole neighbouring days are purged."""
    mine = folds.where(F.col("fold") == fold)
    pick = lambda role: bars.join(F.broadcast(mine.where(F.col("role") == role).select(day)), day, "left_semi")
    train, val = pick("train"), pick("val")
    if horizon_min is not None:
        start = validation_starts(bars, mine, day).select("val_start")
        cutoff = F.col("val_start") - F.expr(f"INTERVAL {horizon_min} MINUTES")
        train = train.crossJoin(F.broadcast(start)).where(F.col("ts").cast("timestamp") < cutoff).drop("val_start")
    return train, val


def split_sizes(bars: DataFrame, folds: DataFrame, horizon_min: int = 60, day: str = "trade_date") -> DataFrame:
    """fold, role, rows after purging.

    Day counts answer all (fold, day) pairs that lie wholly before the cutoff; only days the
    cutoff cuts through are looked at row by row.
    """
    per_day = bars.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("ts").cast("timestamp")).alias("t0"),
                                    F.max(F.col("ts").cast("timestamp")).alias("t1"))
    pairs = folds.join(per_day, day).join(validation_starts(bars, folds, day), "fold").withColumn(
        "cutoff", F.col("val_start") - F.expr(f"INTERVAL {horizon_min} MINUTES"))
    val = pairs.where("role = 'val'").select("fold", "role", "n")
    train = pairs.where("role = 'train'")
    whole = train.where("t1 < cutoff").select("fold", "role", "n")
    cut = train.where("t0 < cutoff AND t1 >= cutoff").select("fold", "role", day, "cutoff")
    partial = bars.select(day, F.col("ts").cast("timestamp").alias("ts")).join(F.broadcast(cut), day).where(
        "ts < cutoff").groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [val, whole, partial]).groupBy("fold", "role").agg(
        F.sum("n").cast("bigint").alias("rows"))
