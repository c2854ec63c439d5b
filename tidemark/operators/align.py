"""Nearest-time alignment of two feeds, window metrics and window validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import floor_to
from tidemark.operators.schema import KEYS

# Alignment scoring.
ALIGNMENT = {
    "tolerance_ms": 1000.0,
    "weight_unmatched": 0.6,
    "weight_distance": 0.4,
    "min_aqs": 0.7,
    "min_dcs": 0.6,
    "min_wvs": 0.6,
    "min_ticks": 1,
    "min_books": 1,
}


#: Rows of both feeds that one task sorts: more rows are dealt over more tasks.
TASK_ROWS = 50_000


def match_feeds(ticks: DataFrame, books: DataFrame, tolerance_s: float, keys: tuple[str, ...] = KEYS,
                ts: str = "ts", seq: str = "seq", bucket_s: float = 60.0) -> DataFrame:
    """For each row of either feed, the row of the other feed nearest in time within the tolerance
    (the earlier one on a tie, the last of equal times before, the first of equal times after).

    keys, ts, side ('tick' / 'dom'), row_id, match_id, match_ts, distance_ms; the last three are
    NULL when nothing is near.

    Spark has no as-of join and a range join would compare all pairs.  Both feeds are united once
    and cut into time buckets at least as wide as the tolerance; a row is copied to a neighbour
    bucket only when it lies within the tolerance of that border.  Inside a bucket, running
    maxima and minima over the time order find both neighbours of every row in linear time.
    Partitions are (keys, bucket), so a hot symbol spreads over its buckets.  The feeds are counted
    first: the number of tasks grows with them, so that what a task sorts does not.
    """
    tol = int(round(tolerance_s * 1_000_000))
    width = max(tol, int(bucket_s * 1_000_000), 1)
    feed = lambda df, side: df.selectExpr(
        *keys, f"{ts} AS ts", f"unix_micros(CAST({ts} AS timestamp)) AS us", f"CAST({seq} AS bigint) AS row_id",
        f"'{side}' AS side")
    bucket = lambda shift: f"CAST(floor((us + {shift}) / CAST({width} AS DECIMAL(20,0))) AS BIGINT)"
    united = feed(ticks, "tick").unionByName(feed(books, "dom"))
    both = united.selectExpr("*", f"explode(array_distinct(array({bucket(-tol)}, {bucket(0)}, {bucket(tol)}))) AS bucket")

    tasks = -(-united.count() // TASK_ROWS)
    if tasks > 1:
        both = both.repartition(tasks, *keys, "bucket")

    cell = Window.partitionBy(*keys, "bucket")
    upto = cell.orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    onward = cell.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spot = lambda side: F.when(F.col("side") == side, F.struct("us", "row_id"))
    other = lambda a, b: F.when(F.col("side") == "tick", a).otherwise(b)
    found = both.withColumns({
        "before": other(F.max(spot("dom")).over(upto), F.max(spot("tick")).over(upto)),
        "after": other(F.min(spot("dom")).over(onward), F.min(spot("tick")).over(onward)),
    }).where(f"bucket = {bucket(0)}")
    return found.selectExpr(
        *keys, "ts", "side", "row_id", "us",
        "CASE WHEN after IS NULL OR us - before.us <= after.us - us THEN before ELSE after END AS hit",
    ).selectExpr(*keys, "ts", "side", "row_id", "hit", f"abs(us - hit.us) <= {tol} AS near", "abs(us - hit.us) AS gap",
    ).selectExpr(
        *keys, "ts", "side", "row_id", "CASE WHEN near THEN hit.row_id END AS match_id",
        "CASE WHEN near THEN timestamp_micros(hit.us) END AS match_ts",
        "CASE WHEN near THEN gap / 1000D END AS distance_ms")


def nearest_match(left: DataFrame, right: DataFrame, tolerance_s: float, keys: tuple[str, ...] = KEYS,
                  ts: str = "ts", seq: str = "seq") -> DataFrame:
    """One direction of ``match_feeds``: every left row with its nearest right row."""
    return match_feeds(left, right, tolerance_s, keys, ts, seq).where("side = 'tick'").drop("side")


def _side(name: str, c: str):
    return F.when(F.col("side") == name, F.col(c))


def _ratios(df: DataFrame, tick: str, dom: str, tick_hit: str, dom_hit: str) -> DataFrame:
    share = lambda m, n: F.when(F.col(n) > 0, F.col(m) / F.col(n)).otherwise(F.lit(0.0))
    lost = lambda m, n: F.col(n) - F.col(m)
    total = F.col(tick) + F.col(dom)
    return df.withColumns({
        "unmatched_tick_count": lost(tick_hit, tick), "unmatched_dom_count": lost(dom_hit, dom),
        "matched_tick_ratio": share(tick_hit, tick), "matched_dom_ratio": share(dom_hit, dom),
        "unmatched_ratio": F.when(total > 0, (lost(tick_hit, tick) + lost(dom_hit, dom)) / total).otherwise(F.lit(1.0)),
    })


def window_metrics(matches: DataFrame, keys: tuple[str, ...] = KEYS, window: str = "1 minute") -> DataFrame:
    """Counts, matched ratios and distances of both feeds per window.

    Both feeds are in one table, so their per-window figures are one aggregate; no join of two.
    """
    average, largest = F.avg, F.max
    out = matches.groupBy(*keys, floor_to("ts", window).alias("window_start")).agg(
        F.count_if(F.col("side") == "tick").alias("tick_count"),
        F.count_if(F.col("side") == "dom").alias("dom_count"),
        F.count(_side("tick", "match_id")).alias("tick_matched_count"),
        F.count(_side("dom", "match_id")).alias("dom_matched_count"),
        average(_side("tick", "distance_ms")).alias("_ta"), average(_side("dom", "distance_ms")).alias("_da"),
        largest("distance_ms").alias("max_alignment_distance_ms"),
        *[f(_side(s, "ts")).alias(f"{s}_{n}") for s in ("tick", "dom") for f, n in ((F.min, "from"), (F.max, "to"))],
    ).withColumn("avg_alignment_distance_ms", F.coalesce((F.col("_ta") + F.col("_da")) / 2.0, "_ta", "_da"))
    return _ratios(out.drop("_ta", "_da"), "tick_count", "dom_count", "tick_matched_count", "dom_matched_count")


def global_metrics(matches: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The eleven alignment totals per group; an absent feed yields the empty-input defaults."""
    out = matches.groupBy(*keys).agg(
        F.count_if(F.col("side") == "tick").alias("total_tick_count"),
        F.count_if(F.col("side") == "dom").alias("total_dom_count"),
        F.count(_side("tick", "match_id")).alias("matched_tick_count"),
        F.count(_side("dom", "match_id")).alias("matched_dom_count"),
        F.avg(_side("tick", "distance_ms")).alias("avg_alignment_distance_ms"),
        F.max(_side("tick", "distance_ms")).alias("max_alignment_distance_ms"),
    )
    return _ratios(out, "total_tick_count", "total_dom_count", "matched_tick_count", "matched_dom_count")


def window_scores(metrics: DataFrame, **override: float) -> DataFrame:
    """Quality score, completeness, validity flag and the list of failed tests."""
    p = {**ALIGNMENT, **override}
    dist = F.coalesce(F.least(F.col("avg_alignment_distance_ms") / p["tolerance_ms"], F.lit(1.0)), F.lit(1.0))
    out = metrics.withColumn("normalized_avg_distance", dist)
    aqs = 1.0 - (p["weight_unmatched"] * F.col("unmatched_ratio") + p["weight_distance"] * F.col("normalized_avg_distance"))
    out = out.withColumn("aqs", F.least(F.lit(1.0), F.greatest(F.lit(0.0), aqs)))
    out = out.withColumn("dcs", F.least("matched_tick_ratio", "matched_dom_ratio"))
    out = out.withColumn("wvs", F.least("aqs", "dcs"))
    tests = [
        ("insufficient_tick_events", F.col("tick_count") < p["min_ticks"]),
        ("insufficient_dom_events", F.col("dom_count") < p["min_books"]),
        ("low_alignment_quality", F.col("aqs") < p["min_aqs"]),
        ("low_data_completeness", F.col("dcs") < p["min_dcs"]),
        ("low_window_validity", F.col("wvs") < p["min_wvs"]),
    ]
    return out.withColumns({
        "window_valid": ~reduce(lambda a, b: a | b, [bad for _, bad in tests]),
        "failure_reason": F.concat_ws(";", *[F.when(bad, F.lit(name)) for name, bad in tests]),
    })


def overlap_windows(metrics: DataFrame, keys: tuple[str, ...] = KEYS, window: str = "1 minute") -> DataFrame:
    """Windows inside the time both feeds cover.

    The cover of each feed is read off the window table (one row per bar time), so neither the
    feeds are scanned again nor is a minute grid built.
    """
    group = Window.partitionBy(*keys)
    lo = F.greatest(F.min("tick_from").over(group), F.min("dom_from").over(group))
    hi = F.least(F.max("tick_to").over(group), F.max("dom_to").over(group))
    known = F.min("tick_from").over(group).isNotNull() & F.min("dom_from").over(group).isNotNull()
    inside = known & (lo <= hi) & F.col("window_start").between(floor_to(lo, window), floor_to(hi, window))
    return metrics.withColumn("_in", inside).where("_in").drop("_in")


def align(ticks: DataFrame, books: DataFrame, tolerance_s: float = 1.0, window: str = "1 minute",
          keys: tuple[str, ...] = KEYS, ts: str = "ts", seq: str = "seq") -> dict[str, DataFrame]:
    """Both match directions, the window metrics and the totals, as lazy tables."""
    matches = match_feeds(ticks, books, tolerance_s, keys, ts, seq)
    return {
        "tick_matches": matches.where("side = 'tick'").drop("side"),
        "dom_matches": matches.where("side = 'dom'").drop("side"),
        "window_metrics": window_metrics(matches, keys, window).drop("tick_from", "tick_to", "dom_from", "dom_to"),
        "global_metrics": global_metrics(matches, keys),
    }


def valid_windows(ticks: DataFrame, books: DataFrame, tolerance_s: float = 1.0, window: str = "1 minute",
                  keys: tuple[str, ...] = KEYS, ts: str = "ts", seq: str = "seq", **override: float) -> DataFrame:
    """Scored windows inside the overlap that pass all tests."""
    metrics = window_metrics(match_feeds(ticks, books, tolerance_s, keys, ts, seq), keys, window)
    return window_scores(overlap_windows(metrics, keys, window), **override).where("window_valid")


def keep_windows(bars: DataFrame, valid: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Bars whose window is valid."""
    return bars.join(valid.select(*keys, F.col("window_start").alias("ts")), [*keys, "ts"], "left_semi")
