"""A stored table of out-of-fold probabilities: extended by new symbol-days, refreshed by a newer model.

Every row carries the version of the model that scored it, so a refresh that was stopped goes on where it was and one
that is done does nothing.  Days are replaced whole (dynamic partition overwrite); all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models.oof import PROBS, Fit, classes_of, training_rows
from tidemark.operators.schema import MODEL_FEATURES
from tidemark.session import stage
from tidemark.sources.sinks import append_aligned, new_pairs_only, replace_days, write_table

VERSION = "model_version"


def save_scores(scored: DataFrame, path: str, version: str) -> None:
    """Store a first table of scored bars."""
    write_table(scored.withColumn(VERSION, F.lit(version)), path)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; a column that only later days have is NULL in earlier ones."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def extend_scores(bars: DataFrame, path: str, fit: Fit, label: str, version: str, features: list[str] | None = None,
                  horizon_min: int = 60, least_classes: int = 2) -> DataFrame:
    """Score the symbol-days of ``bars`` that the table lacks and append them; returns (trade_date, rows) of what came.

    Walk forward: each new day is scored by a model of the labelled bars before it whose label does not reach into it.
    Columns are aligned by name with the stored ones.  A day with fewer than ``least_classes`` before it has nothing
    to learn from and is left for a later call; with 0, every day is scored now.  The loop is over new days, and each fit runs on the cluster.
    """
    features = features or MODEL_FEATURES
    spark = bars.sparkSession
    stored = scores(spark, path)
    bars = stage(bars)
    fresh = stage(new_pairs_only(bars, stored))
    starts = fresh.groupBy("trade_date").agg(F.min(F.col("ts").cast("timestamp")).alias("start"))
    parts = []
    for day in starts.orderBy("trade_date").collect():  # new days of the calendar
        before = bars.where((F.col("trade_date") < F.lit(day.trade_date))
                            & (F.col("ts").cast("timestamp") < F.lit(day.start) - F.expr(f"INTERVAL {horizon_min} MINUTES")))
        rows = stage(training_rows(before, label, features))
        if len(classes_of(rows)) >= least_classes:
            parts.append(fit(rows, features)(fresh.where(F.col("trade_date") == F.lit(day.trade_date))))
    if not parts:
        return spark.createDataFrame([], "trade_date date, rows bigint")
    new = reduce(DataFrame.unionByName, parts).withColumn(VERSION, F.lit(version))
    new = stage(append_aligned(stored.limit(0), new))
    write_table(new, path, mode="append")
    return new.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))


def refresh_scores(spark: SparkSession, path: str, scorer: Callable[[DataFrame], DataFrame], version: str,
                   since: str | None = None) -> DataFrame:
    """Score stored days again with another model; returns (trade_date, rows) of the days that were replaced.

    Only days (from ``since`` on) with a row of another version are read and written, all other columns of theirs stay.
    """
    stored = scores(spark, path)
    chosen = stored if since is None else stored.where(F.col("trade_date") >= F.lit(since).cast("date"))
    stale = chosen.where(~F.col(VERSION).eqNullSafe(F.lit(version))).select("trade_date").distinct()
    rows = stored.join(F.broadcast(stale), "trade_date", "left_semi")  # one row per day of the calendar
    again = scorer(rows.drop(*PROBS, VERSION)).withColumn(VERSION, F.lit(version))
    again = stage(again.select(*stored.columns))  # the days are overwritten while they are read
    replace_days(again, path)
    return again.groupBy("trade_date").agg(F.count(F.lit(1)).alias("rows"))
