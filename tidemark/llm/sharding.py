"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row at place r of n gets the fraction (r + 1/2) / n.  Sorted by
that fraction all sources run at their own even pace, so every cut into equal runs holds each source in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000


def _running(counts: DataFrame, keys: list[str], bucket: str, n: str, out: str) -> DataFrame:
    """Rows before each bucket of its group (all rows if keys is empty)."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn(out, F.coalesce(F.sum(n).over(window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def shuffled_order(key: str | Column, seed: str) -> Column:
    """A seeded shuffle as a sort key; equal keys give equal values."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))


def interleave(rows: DataFrame, shards: int, seed: str = "0", key: str = "doc_id", source: str = "source",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 within a shard); shard sizes are at most one row apart.

    NULL sources form a stratum of their own; NULL keys sort first in their source's order.  Rows that are equal in
    source and key share a shuffle value and get neighbouring places in any order.  More shards than rows leave
    some empty.  Former columns shard and slot are replaced, all others are carried along.

    No source is ranked by one task: rows are dealt by ranges of the shuffle value, and later of the fraction, into
    buckets of about rows_per_bucket rows; ranks within a bucket are added to the counts of the buckets before it.
    """
    rows = rows.drop("shard", "slot")
    total = rows.count()
    buckets = max(1, -(-total // rows_per_bucket))
    order = shuffled_order(key, seed)
    dealt = rows.withColumns({"_order": order, "_bucket": (F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long"),
                              "_source": F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source).cast("string"), F.lit("")))})
    counts = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    counts = _running(counts, ["_source"], "_bucket", "_n", "_before").withColumn("_size", F.sum("_n").over(Window.partitionBy("_source"))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_order", key))
    ranked = dealt.join(counts, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + within - 1)
    # fraction as an exact pair of integers: its floor on the bucket grid, then the remainder over the same size
    twice = F.col("_rank") * 2 + 1
    ranked = ranked.withColumns({"_at": F.floor(twice * F.lit(buckets) / (F.col("_size") * 2)).cast("long"),
                                 "_fraction": twice / (F.col("_size") * 2)}).drop("_before", "_bucket", "_rank", "_size")
    starts = _running(ranked.groupBy("_at").agg(F.count("*").alias("_n")), [], "_at", "_n", "_before").drop("_n")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_at").orderBy("_fraction", "_source", "_order", key)) - 1
    placed = ranked.join(starts, "_at").withColumn("_place", place)
    # shard s takes places ceil(s * total / shards) and on, so that sizes differ by one row at most
    shard = F.expr(f"(_place * {shards}L) div {max(1, total)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", (F.col("_place") - first).cast("long")).select(*rows.columns, "shard", "slot")
