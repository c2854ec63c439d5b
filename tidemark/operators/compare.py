"""Table comparison, bar reconciliation and audit-list joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.clock import exchange_time


def table_diff(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12,
               examples: int = 5) -> DataFrame:
    """Per shared column: compared rows, mismatches, percent and a few example keys; rows present on
    one side only are reported under ``<rows>``.

    One keyed full join, then one aggregate with map-side counts.  Examples are kept as the
    smallest few keys through a bounded top-k per column, not as a list of all mismatches.
    """
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, F.struct(*shared).alias("l"))
    right = b.select(*keys, F.struct(*shared).alias("r"))
    joined = left.join(right, keys, "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()

    def differs(field: T.StructField):
        x, y = F.col(f"l.{field.name}"), F.col(f"r.{field.name}")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            near = (F.abs(x - y) <= atol + rtol * F.abs(y)) | (F.isnan(x) & F.isnan(y))
            return ~F.coalesce(near, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    key_text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    checks = [F.struct(F.lit("<rows>").alias("column"), F.lit(True).alias("compared"), (~both).alias("bad"))]
    checks += [F.struct(F.lit(f.name).alias("column"), both.alias("compared"), (both & differs(f)).alias("bad"))
               for f in a.schema.fields if f.name in shared]
    long = joined.select(key_text.alias("key"), F.explode(F.array(*checks)).alias("c")).select("key", "c.*")
    counts = long.groupBy("column").agg(
        F.count_if("compared").alias("rows"), F.count_if("bad").alias("mismatches"))
    wrong = long.where("bad")
    # a window top-k is pushed below the shuffle as a per-task limit
    w = Window.partitionBy("column").orderBy("key")
    sample = wrong.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= examples).groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_list("key")), ";").alias("examples"))
    return counts.join(sample, "column", "left").select(
        "column", "rows", "mismatches",
        F.when(F.col("rows") > 0, F.col("mismatches") * 100.0 / F.col("rows")).otherwise(F.lit(0.0)).alias("pct"),
        F.coalesce("examples", F.lit("")).alias("examples"))


def bar_reconcile(live: DataFrame, batch: DataFrame, fields: list[str], keys: tuple[str, ...] = ("symbol", "ts"),
                  limit_pct: float = 5.0) -> DataFrame:
    """Per field: matched bars, largest absolute and percentage error, bars over the limit."""
    l = live.select(*keys, F.struct(*fields).alias("l"))
    joined = l.join(batch.select(*keys, F.struct(*fields).alias("b")), list(keys))
    long = joined.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.abs(F.col(f"l.{f}") - F.col(f"b.{f}")).cast("double").alias("err"),
                 F.greatest(F.col(f"b.{f}").cast("double"), F.lit(1.0)).alias("base"))
        for f in fields])).alias("r")).select("r.*")
    pct = F.col("err") * 100.0 / F.col("base")
    return long.groupBy("field").agg(
        F.count(F.lit(1)).alias("bars"), F.max("err").alias("max_abs_error"), F.max(pct).alias("max_pct_error"),
        F.count_if(pct > limit_pct).alias("bars_over_limit"))


def audit_list(bars: DataFrame, targets: DataFrame, pred: str = "pred", first: int = 5) -> DataFrame:
    """Each target (trade_date, symbol, side) with the clock times of the first few alerts of both
    sides; a target without bars is reported as missing."""
    keys = ["trade_date", "symbol"]
    wanted = targets.select(*keys).distinct()
    clock = exchange_time("ts")
    alerts = bars.join(wanted, keys, "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        *[F.count_if(F.col(pred) == s).alias(f"{s.lower()}_alerts") for s in ("LONG", "SHORT")],
        # a symbol-day holds at most one alert per bar time
        *[F.slice(F.sort_array(F.collect_list(F.when(F.col(pred) == s, F.struct("ts", clock.alias("c"))))), 1, first)
          .alias(f"_{s.lower()}") for s in ("LONG", "SHORT")])
    text = lambda s: F.when(F.size(f"_{s}") > 0, F.concat(
        F.array_join(F.transform(f"_{s}", lambda x: x["c"]), ", "),
        F.when(F.col(f"{s}_alerts") > first, "...").otherwise(""))).otherwise("None")
    return targets.join(alerts, keys, "left").select(
        *keys, "side", F.col("bars").isNull().alias("missing"),
        *[F.coalesce(f"{s}_alerts", F.lit(0)).alias(f"{s}_alerts") for s in ("long", "short")],
        *[F.coalesce(text(s), F.lit("None")).alias(f"{s}_times") for s in ("long", "short")])
