"""Exact global order without a one-task window: prefix sums, quantiles, ranks, deciles, top-k.

An unpartitioned window (or an exact ``percentile``) would put all rows into one task.  Here
rows are first reduced to counts per distinct value, the value range is cut into buckets at
approximate quantiles (a bounded sketch), and running sums are taken inside a bucket with the
totals of earlier buckets added.  Cut points only balance the work; results are exact.
The counts are read three times (cut points, totals, sums), so they are staged once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import col
from tidemark.session import stage


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which NULL keys meet NULL keys; keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    met = left.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]))
    return met.drop(*[f"_r_{k}" for k in keys])


def prefix_sums(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None,
                order: list[str] | None = None, buckets: int | None = None, descending: bool = False) -> DataFrame:
    """Adds before_{s} and total_{s}: sums over all rows ordered ahead, and over the group.

    ``order`` lists further sort columns after ``value``.  Rows are ordered by the value itself; its
    double only chooses the bucket.  NULL values come first, NULL groups are groups.  By default there are
    as many buckets as the session has shuffle partitions, 8 at least.
    """
    by = list(by or [])
    buckets = buckets or max(8, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort_value = -F.col(value) if descending else F.col(value)
    work = stage(counts.withColumns({"_sorted": sort_value, "_v": sort_value.cast("double")}))
    probs = [i / buckets for i in range(1, buckets)]
    cut = F.percentile_approx("_v", probs, 1000).alias("_cuts")
    if by:
        work = same_keys(work, work.groupBy(*by).agg(cut), by)
    else:
        work = work.crossJoin(F.broadcast(work.agg(cut)))
    work = work.withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))).drop("_cuts")
    totals = work.groupBy(*by, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # one row per bucket: a small table whatever the size of the data
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(group).alias(f"total_{s}") for s in sums],
    )
    inner = (Window.partitionBy(*by, "_b").orderBy("_sorted", *(order or []))
             .rowsBetween(Window.unboundedPreceding, -1))
    return (
        same_keys(work, offsets, [*by, "_b"])
        .withColumns({f"before_{s}": F.coalesce(F.sum(s).over(inner), F.lit(0)) + F.col(f"_o_{s}") for s in sums})
        .drop("_sorted", "_v", "_b", *[f"_o_{s}" for s in sums])
    )


#: Moments over a table of counts (_x, n), for ``exact_quantiles``.
MEAN = "sum(_x * n) / sum(n)"
DEVIATION = "sqrt(greatest(sum(_x * _x * n) / sum(n) - power(sum(_x * n) / sum(n), 2), 0.0D))"


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    more: dict[str, str] | None = None) -> DataFrame:
    """by..., q: linearly interpolated quantiles in the order of ``probs``, and ``n``.

    All comes from one table of counts per distinct value; ``more`` names further aggregates over
    it, as SQL over the value _x and its count n.
    """
    by = list(by or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(counts, "_x", ["n"], by)
    lo, hi = F.col("before_n"), F.col("before_n") + F.col("n")
    picks = []
    for i, p in enumerate(probs):
        pos = (F.col("total_n") - 1) * F.lit(float(p))
        for side, at in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            picks.append(F.max(F.when((lo <= at) & (at < hi), F.col("_x"))).alias(f"_{side}{i}"))
    further = [F.expr(sql).alias(name) for name, sql in (more or {}).items()]
    agg = ranked.groupBy(*by).agg(F.max("total_n").alias("_n"), *picks, *further).withColumnRenamed("_n", "n")
    out = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        out.append(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (pos - F.floor(pos)))
    return agg.select(*by, F.array(*out).alias("q"), "n", *(more or {}))


def global_rank(df: DataFrame, value: str, order: list[str], by: list[str] | None = None,
                split: str = "trade_date", descending: bool = False) -> DataFrame:
    """Adds rn (1..n) and n within ``by``, ordered by value, then ``split``, then ``order``.

    Rows are numbered inside (value, split); a value shared by a large part of the data is
    therefore still spread over the values of ``split``.
    """
    by = list(by or [])
    if {"rn", "n"} & set(df.columns):
        raise ValueError("columns rn and n are added here and must not exist")
    extra = [] if split in by else [split]
    counts = df.groupBy(*by, value, *extra).agg(F.count(F.lit(1)).alias("n"))
    ahead = prefix_sums(counts, value, ["n"], by, extra, descending=descending).select(
        *by, value, *extra, "before_n", "total_n")
    w = Window.partitionBy(*by, value, *extra).orderBy(*order)
    return (
        same_keys(df, ahead, [*by, value, *extra])
        .withColumn("rn", F.row_number().over(w) + F.col("before_n"))
        .withColumnRenamed("total_n", "n").drop("before_n")
    )


def decile_of(rn, n, parts: int = 10):
    """Equal-frequency bin of rank rn out of n, edges interpolated as quantile cuts do: 1..parts."""
    rn, n = col(rn), col(n)
    steps = (rn - 1) * parts + (n - 2)
    upper = (steps - F.pmod(steps, n - 1)) / (n - 1)
    return F.when(n > 1, F.greatest(F.lit(1.0), upper)).otherwise(F.lit(1.0)).cast("bigint")


def top_fraction(df: DataFrame, score: str, fraction: float, ties: list[str], at_least: int = 1) -> DataFrame:
    """The floor(n x fraction) rows with the highest score (at least ``at_least``).

    Exact for any fraction: a 10 % cut of a large table is a filter on the global rank, not a
    sort limit that would pass through the driver.
    """
    scored = df.where(F.col(score).isNotNull())
    ranked = global_rank(scored, score, ties, descending=True)
    size = F.greatest(F.lit(at_least), F.floor(F.col("n") * F.lit(float(fraction))))
    return ranked.where(F.col("rn") <= size)


def best_row(df: DataFrame, order: list, where=None) -> DataFrame:
    """The first row by ``order`` among rows passing ``where``; all rows when none passes."""
    if where is None:
        return df.orderBy(*order).limit(1)
    return df.orderBy(F.when(where, 0).otherwise(1), *order).limit(1)
