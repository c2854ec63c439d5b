"""Live path as Structured Streaming: snapshots -> bars with features -> scores -> signals.

Two keyed stateful steps joined by a table.  The key is (symbol, day), so a new day starts
clean and the state of an old day is dropped by an event-time timer.  State lives in the state
store and is restored from the query checkpoint after a restart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from tidemark.functions.clock import as_utc, exchange_time, in_session, order_key, seconds_of
from tidemark.functions.scalars import is_equity
from tidemark.models.oof import load_scorer
from tidemark.operators.schema import KEYS, MODEL_FEATURES
from tidemark.operators.sequences import BYPASS_PROB
from tidemark.streaming import book as K

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_DELAY = "2 minutes"

BAR_SCHEMA = ", ".join(
    ["symbol string", "trade_date date", "ts timestamp"]
    + [f"{c} double" for c in K.BAR if c not in ("ts", *K.SUMS)] + [f"{c} bigint" for c in K.SUMS]
    + [f"{c} double" for c in [*MODEL_FEATURES, "roc_3"]])
SIGNAL_SCHEMA = (
    "symbol string, trade_date date, ts timestamp, direction string, entry_price double, entry_time_ist string, "
    "prob double, theta_prob double, prob_long double, prob_short double, prob_no_trade double, roc_at_entry double, "
    "delta_value_lakhs double, theta_caught_time string, mark1_time string, between_time string, "
    "daily_open_passed boolean, bypass_used boolean, rejection_reason string")


def _fields(names: list[str], whole: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {'bigint' if n in whole else 'double'}" for n in names)


# State of a symbol-day: typed fields, so that the state store reads and writes them as columns; the snapshots of open bars,
# which can be a whole day's, as one block of bytes.
BAR_STATE = (f"before array<struct<{_fields(K.SNAPSHOT, ('ts', 'seq'))}>>, open binary, "
             f"bars array<struct<{_fields(K.BAR, ('ts',))}>>, recent array<double>, large double, timer bigint")
_SIDE = "struct<stage int, at array<string>, prob double>"
SIGNAL_STATE = f"open double, upward {_SIDE}, downward {_SIDE}"


def _rows(frame: pd.DataFrame, whole: tuple[str, ...]) -> list[tuple]:
    """Rows as state keeps them: whole numbers and doubles."""
    return list(zip(*[frame[c].astype("int64" if c in whole else "float64").tolist() for c in frame.columns]))


def prepare_session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _day_end_ms(day) -> int:
    """One hour after the end of the day, when its state is dropped."""
    return int((pd.Timestamp(day) + pd.Timedelta(hours=25)).timestamp() * 1000)


class BarProcessor(StatefulProcessor):
    """Bars and features of one symbol-day.

    State: the snapshot before the open bar, the open bar's snapshots, the last twenty bars, the
    recent trade quantities and the large-trade limit.  A bar closes when the watermark passes its
    end, so the result does not depend on how rows fall into micro-batches; rows behind the
    watermark are dropped and counted by Spark (``late_rows``).  What is still open at the end of
    the input comes from ``flush``.
    """

    def __init__(self, width_s: int, max_gap_s: float | None):
        self.width, self.gap = width_s * 1_000_000, max_gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", BAR_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.day.exists():
            self.handle.registerTimer(_day_end_ms(key[1]))
        state = self._load()
        fresh = pd.concat(list(rows))[K.SNAPSHOT].sort_values(["ts", "seq"], kind="stable")
        yield from self._advance(key, state, fresh, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        if expiredTimerInfo.getExpiryTimeInMs() == state["timer"]:
            state["timer"] = None
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._advance(key, state, None, watermark * 1000)
        if watermark >= _day_end_ms(key[1]):
            self.day.clear()

    def close(self) -> None:
        pass

    PARTS = ("before", "open", "bars", "recent", "large", "timer")

    def _load(self) -> dict:
        if self.day.exists():
            return self.unpacked(self.day.get())
        return {"before": [], "open": b"", "bars": [], "recent": [], "large": None, "timer": None}

    @classmethod
    def unpacked(cls, values) -> dict:
        state = dict(zip(cls.PARTS, values))
        return state | {n: [tuple(r) for r in state[n]] for n in ("before", "bars")} | {"open": bytes(state["open"]), "recent": list(state["recent"])}

    def _advance(self, key, state, fresh, watermark) -> Iterator[pd.DataFrame]:
        held = K.snapshots(state["open"])
        rows = held if fresh is None else pd.concat([held, fresh]) if len(held) else fresh
        if rows.empty:
            return
        rows = rows.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
        start = rows["ts"] - rows["ts"] % self.width
        done = start + self.width <= (-1 if watermark is None else watermark)
        if done.any():
            closing = rows[done]
            yield self._close(key, state, closing)
            state["before"] = _rows(closing[K.SNAPSHOT].iloc[-1:], ("ts", "seq"))
        state["open"] = K.packed(rows[~done])
        if state["open"]:
            self._set_timer(state, int(start[~done].iloc[0]) + self.width)
        self.day.update(tuple(state[n] for n in self.PARTS))

    def _set_timer(self, state, end_us: int) -> None:
        wanted = end_us // 1000
        if state["timer"] != wanted:
            if state["timer"] is not None:
                self.handle.deleteTimer(state["timer"])
            self.handle.registerTimer(wanted)
            state["timer"] = wanted

    def _close(self, key, state, closing: pd.DataFrame) -> pd.DataFrame:
        before = pd.DataFrame(state["before"], columns=K.SNAPSHOT)
        rows = (pd.concat([before, closing]) if len(before) else closing).reset_index(drop=True)
        trades = K.find_trades(rows)
        if self.gap is not None:  # a snapshot after a long silence has no usable predecessor
            stale = rows["ts"].diff() > self.gap * 1e6
            trades = trades[~stale.loc[trades["row"]].to_numpy()]
        flags, state["recent"], state["large"] = K.flag_large(trades["qty"].to_numpy(), state["recent"], state["large"])
        trades = trades.assign(is_large=flags)
        bars = K.make_bars(rows.iloc[len(before):], trades, self.width)
        past = pd.DataFrame(state["bars"], columns=K.BAR)
        known = pd.concat([past, bars]).reset_index(drop=True) if len(past) else bars
        out = known.join(K.bar_features(known)).iloc[len(past):]
        state["bars"] = _rows(known[K.BAR].tail(K.HISTORY), ("ts",))
        return out.assign(symbol=key[0], trade_date=key[1], ts=pd.to_datetime(out["ts"].astype("int64"), unit="us"),
                          **{c: out[c].astype("int64") for c in K.SUMS})[
            ["symbol", "trade_date", *K.BAR[:1], *[c for c in K.BAR[1:] if c not in K.SUMS], *K.SUMS, *MODEL_FEATURES, "roc_3"]]


def live_bars(snapshots: DataFrame, bar: str = "1 minute", delay: str = DEFAULT_DELAY, session: bool = True,
              max_gap_s: float | None = 3600.0) -> DataFrame:
    """Stream of closed bars with trade flow and features.  Rows later than ``delay`` are dropped
    by the watermark."""
    prepare_session(snapshots.sparkSession)
    df = snapshots.withColumn("event_time", as_utc("ts"))
    if session:
        df = df.where(in_session("event_time", closed_end=True))
    df = df.withWatermark("event_time", delay).select(
        *KEYS, "event_time", F.unix_micros("event_time").alias("ts"), F.col("seq").cast("bigint").alias("seq"),
        F.col("ltp").cast("double").alias("ltp"), *[F.col(c).cast("double").alias(c) for c in K.LEVELS])
    return df.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=BarProcessor(seconds_of(bar), max_gap_s), outputStructType=BAR_SCHEMA,
        outputMode="Append", timeMode="EventTime")


def book_bars_stream(snapshots: DataFrame, bar: str = "1 minute", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Price and book part of the bars as a plain watermarked window aggregate (no Python)."""
    df = snapshots.withColumn("event_time", as_utc("ts")).withWatermark("event_time", delay)
    order = order_key("event_time", "seq")
    return df.groupBy("symbol", "trade_date", F.window("event_time", bar)).agg(
        F.min_by("ltp", order).alias("open_price"), F.max("ltp").alias("high_price"), F.min("ltp").alias("low_price"),
        F.max_by("ltp", order).alias("close_price"), F.avg("ltp").alias("ltp"),
        *[F.avg(c).alias(c) for c in K.LEVELS],
    ).withColumn("ts", F.col("window.start")).drop("window")


class SignalProcessor(StatefulProcessor):
    """Double-momentum state of one symbol-day, LONG and SHORT apart; each direction signals once.

    When the watermark passes the end of the day, directions that never triggered report why.
    """

    STAGES = ("IDLE", "ARMING", "MARK1", "BETWEEN", "TRIGGERED")
    REASONS = dict(zip(STAGES, ("NO_ALERT", "MARK1_NEVER", "BETWEEN_NEVER", "MARK2_NEVER", "TRIGGERED")))

    def __init__(self, long_theta: float, short_theta: float, report_misses: bool):
        self.theta, self.report = {"LONG": long_theta, "SHORT": short_theta}, report_misses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day = handle.getValueState("day", SIGNAL_STATE)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        first, *sides = self.day.get()
        return {"open": first} | {d: {"stage": s[0], "at": list(s[1]), "prob": s[2]} for d, s in zip(self.theta, sides)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.day.exists():
            state = self._load()
        else:
            state = {"open": None, **{d: {"stage": 0, "at": [], "prob": None} for d in self.theta}}
            self.handle.registerTimer(_day_end_ms(key[1]))
        found = []
        for bar in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            state["open"] = float(bar.open_price) if state["open"] is None else state["open"]
            for direction in self.theta:
                found += self._step(key, state, state[direction], direction, bar)
        self.day.update((state["open"], *[(own["stage"], own["at"], own["prob"]) for own in (state[d] for d in self.theta)]))
        if found:
            yield pd.DataFrame(found)

    def _step(self, key, state, own, direction, bar) -> list[dict]:
        sign = 1.0 if direction == "LONG" else -1.0
        prob = bar.prob_long if sign > 0 else bar.prob_short
        beyond = bar.roc_3 * sign >= 1.0
        moves = (prob >= self.theta[direction], beyond, bar.roc_3 * sign < 1.0, beyond, False)
        if not moves[own["stage"]]:
            return []
        own["stage"] += 1
        own["at"].append(bar.clock)
        if own["stage"] == 1:
            own["prob"] = float(prob)
        if own["stage"] < 4:
            return []
        ahead = (bar.ltp - state["open"]) * sign > 0
        bypass = not ahead and sign > 0 and prob >= BYPASS_PROB
        late = bar.clock >= "15:00:00"
        reason = "CUTOFF_REJECTED_15:00" if late else "EXECUTED" if ahead or bypass else "DAILY_OPEN_FAILED"
        return [self._row(key, direction, own, reason, ts=bar.ts, entry_price=bar.ltp, entry_time_ist=bar.clock, prob=prob,
                          prob_long=bar.prob_long, prob_short=bar.prob_short, prob_no_trade=bar.prob_no_trade,
                          roc_at_entry=bar.roc_3, delta_value_lakhs=bar.delta_1m * bar.ltp / 100000.0,
                          daily_open_passed=bool(ahead or bypass) and not late, bypass_used=bool(bypass) and not late)]

    def _row(self, key, direction, own, reason, **values) -> dict:
        at = own["at"] + [None] * 3
        base = {"symbol": key[0], "trade_date": key[1], "ts": pd.NaT, "direction": direction, "entry_price": None,
                "entry_time_ist": None, "prob": None, "theta_prob": own["prob"], "prob_long": None, "prob_short": None,
                "prob_no_trade": None, "roc_at_entry": None, "delta_value_lakhs": None, "theta_caught_time": at[0],
                "mark1_time": at[1], "between_time": at[2], "daily_open_passed": False, "bypass_used": False,
                "rejection_reason": reason}
        return {**base, **values}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.day.exists():
            state = self._load()
            self.day.clear()
            missed = [self._row(key, d, state[d], self.REASONS[self.STAGES[state[d]["stage"]]])
                      for d in self.theta if state[d]["stage"] < 4]
            if missed and self.report:
                yield pd.DataFrame(missed)


def live_signals(scored_bars: DataFrame, long_theta: float = 0.25, short_theta: float = 0.25,
                 delay: str = DEFAULT_DELAY, report_misses: bool = False) -> DataFrame:
    """Stream of signals from a stream of scored bars."""
    prepare_session(scored_bars.sparkSession)
    df = scored_bars.withColumn("event_time", as_utc("ts")).withWatermark("event_time", delay).select(
        *KEYS, "event_time", as_utc("ts").alias("ts"), exchange_time("ts").alias("clock"), "open_price", "ltp", "roc_3",
        "delta_1m", "prob_long", "prob_short", "prob_no_trade")
    return df.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=SignalProcessor(long_theta, short_theta, report_misses), outputStructType=SIGNAL_SCHEMA,
        outputMode="Append", timeMode="EventTime")


def score_bars(bars: DataFrame, model_path: str, features: list[str] | None = None) -> DataFrame:
    """Class probabilities of a stored model beside the bars, which may be a stream: scoring looks at one row at a time,
    so a replay has the scores of the batch."""
    return load_scorer(model_path, features)(bars)


def model_signals(bars: DataFrame, model_path: str, features: list[str] | None = None, **options) -> DataFrame:
    """Stream of signals from a stream of closed bars, scored by a stored model on the way (``live_signals`` options)."""
    return live_signals(score_bars(bars, model_path, features), **options)


def tradable(signals: DataFrame, mode: str = "VIRTUAL") -> DataFrame:
    """Signals of single equities only, marked with the running mode."""
    return signals.where(is_equity("symbol")).withColumn("mode", F.lit(mode))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True,
                 transform: Callable[[DataFrame], DataFrame] | None = None):
    """Append each micro-batch to a parquet table, optionally through a batch transform (model scoring).

    A batch id column makes a replayed batch replace itself instead of appearing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        (out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    if once:
        query.awaitTermination()
    return query


class LateRows(StreamingQueryListener):
    """Adds up, over all batches of every query of the session, the rows that came behind the watermark."""

    def __init__(self) -> None:
        self.rows: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.id)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows[str(event.id)] += 0

    def of(self, query) -> int:
        return self.rows[str(query.id)]


def count_late_rows(spark: SparkSession) -> LateRows:
    """Start counting; ``spark.streams.removeListener`` ends it.  Spark reports a batch shortly after it is done."""
    late = LateRows()
    spark.streams.addListener(late)
    return late


def late_rows(query) -> int:
    """Rows that a query dropped because they came behind its watermark, in its last hundred batches; ``count_late_rows``
    has them all."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def flush(spark: SparkSession, checkpoint: str, bar: str = "1 minute", max_gap_s: float | None = 3600.0) -> DataFrame:
    """Bars that a stopped ``live_bars`` query still holds open, from its state: the end of the input.

    ``bar`` and ``max_gap_s`` as in the query.  The state itself is left as it is, so the query can go on later.
    """
    prepare_session(spark)
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "day").load()
    kept = kept.select("key.symbol", "key.trade_date", *[F.col(f"value.{n}").alias(n) for n in BarProcessor.PARTS])
    processor = BarProcessor(seconds_of(bar), max_gap_s)

    def close(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                plain = lambda part: [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in part]
                state = processor.unpacked([plain(r.before), r.open, plain(r.bars), r.recent, None if pd.isna(r.large) else r.large, None])
                if state["open"]:
                    yield processor._close((r.symbol, r.trade_date), state, K.snapshots(state["open"]))
    return kept.mapInPandas(close, BAR_SCHEMA)


def state_summary(signals: DataFrame) -> DataFrame:
    """Signals and misses per direction and reason."""
    return signals.groupBy("direction", "rejection_reason").agg(F.count(F.lit(1)).alias("n"))
