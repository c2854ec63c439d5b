"""Classifier metrics as table aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import prefix_sums


def confusion(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return df.where(F.col(truth).isNotNull()).groupBy(
        *by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def mcc(df: DataFrame, truth: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Multi-class Matthews correlation from the confusion counts (a handful of rows per group)."""
    by = list(by or [])
    counts = confusion(df, truth, pred, by)
    one = F.lit(1).alias("_one")
    totals = counts.groupBy(*by, one).agg(
        F.sum("n").cast("double").alias("s"),
        F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))), F.lit(0)).cast("double").alias("c"))
    sides = counts.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
    )).alias("r")).select(*by, "r.*")
    labels = sides.groupBy(*by, "label").agg(F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"))
    products = labels.groupBy(*by, one).agg(
        F.sum(F.col("p") * F.col("t")).alias("pt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return totals.join(products, [*by, "_one"]).select(
        *by, F.col("s").cast("bigint").alias("rows"),
        F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / den).otherwise(F.lit(0.0)).alias("mcc"))


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """label, precision, recall, f1, support."""
    counts = confusion(df, truth, pred)
    sides = counts.select("n", F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.lit("t").alias("k")),
        F.struct(F.col("pred").alias("label"), F.lit("p").alias("k")),
        F.struct(F.when(F.col("truth") == F.col("pred"), F.col("truth")).alias("label"), F.lit("c").alias("k")),
    )).alias("r")).select("n", "r.*").where("label IS NOT NULL")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    t = sides.groupBy("label").agg(of("t").alias("t"), of("p").alias("p"), of("c").alias("c"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = t.withColumns({"precision": rate(F.col("c"), F.col("p")), "recall": rate(F.col("c"), F.col("t"))})
    p, r = F.col("precision"), F.col("recall")
    return out.select("label", "precision", "recall", rate(2 * p * r, p + r).alias("f1"), F.col("t").alias("support"))


def average_precision(df: DataFrame, score: str, positive, by: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall steps, at distinct scores.

    Rows are reduced to (score, positives, count) before any ordering; running sums then work on
    buckets of the score range, so no task sees all scores of a group.
    """
    by = list(by or [])
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    run = prefix_sums(counts, "score", ["pos", "n"], by, descending=True)
    hits = F.col("before_pos") + F.col("pos")
    seen = F.col("before_n") + F.col("n")
    step = F.col("pos") / F.nullif(F.col("total_pos"), F.lit(0)) * hits / seen
    return run.groupBy(*by).agg(
        F.max("total_n").cast("bigint").alias("rows"), F.max("total_pos").cast("bigint").alias("positives"),
        F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def fold_summary(per_fold: DataFrame, metric: str, by: list[str] | None = None) -> DataFrame:
    by = list(by or [])
    return per_fold.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.avg(metric).alias(f"{metric}_mean"),
        F.stddev_pop(metric).alias(f"{metric}_std"))


def ranked(df: DataFrame, score: str, by: list[str], ties: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc(score), *ties)).cast("bigint"))
