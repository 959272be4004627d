"""Closed-candle streams: bar building, duplicate suppression, strategy steps, paper journal."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlight.operators.bars import OHLCV


def stream_bars(bars: DataFrame, timeframe_ms: int, delay: str, name: str) -> DataFrame:
    """Coarser bars from a stream of finer ones; only closed buckets leave.

    The watermark closes a bucket; rows behind it are late and dropped here.
    """
    timed = bars.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", delay)
    out = timed.groupBy("symbol", F.window("ts", f"{timeframe_ms} milliseconds").alias("w")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"),
        F.sum("v").alias("v"))
    return out.select("symbol", F.lit(name).alias("timeframe"), F.unix_millis("w.start").alias("t"), *OHLCV)


def late_rows(batch: DataFrame, closed_until_ms: int, timeframe_ms: int) -> DataFrame:
    """Rows of a micro-batch whose bucket had been closed before: reported as missed."""
    end = (F.floor(F.col("t") / timeframe_ms) + 1) * timeframe_ms
    return batch.where(end <= closed_until_ms).withColumns(
        {"freshness": F.lit("MISSED"), "freshness_reason": F.lit("OBSERVATION_LAG")})


def unique_events(events: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["event_id"])


def after_arming(events: DataFrame, arming_ms: int) -> DataFrame:
    """Events behind the arming point only; later starts resume from the checkpoint."""
    return events.where(F.col("candle_close_t") > arming_ms)


# --- strategy steps ---------------------------------------------------------------

STEP_SCHEMA = ("symbol string, timeframe string, strategy_id string, kind string, t bigint, candle_close_t bigint, "
               "state_before int, state_after int, detail string")
STATE_SCHEMA = "cursor bigint, position int, last string, rule binary"


class StrategyStep(StatefulProcessor):
    """One step per closed bar: a position change gives an event.

    A repeated bar is ignored, a changed repeat or an earlier bar is reported
    as an error row, and a gap blocks: the bar is reported and not applied.
    ``make`` builds a step object fed with ``(o, h, l, c, v)`` that returns the
    bar's raw signal; its state is bounded.
    """

    def __init__(self, strategy_id: str, make: Callable, interval_ms: int, target: bool = False):
        self.strategy_id, self.make, self.interval, self.target = strategy_id, make, interval_ms, target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol, timeframe = key
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable", ignore_index=True)
        if self.state.exists():
            cursor, position, last, blob = self.state.get()
            rule = pickle.loads(blob)
        else:
            cursor, position, last, rule = None, 0, "", self.make()
        out = []

        def report(kind, t, before, after, detail=""):
            out.append((symbol, timeframe, self.strategy_id, kind, t, t + self.interval, before, after, detail))

        for t, *ohlcv in pdf[["t", *OHLCV]].itertuples(index=False, name=None):
            t, text = int(t), repr(ohlcv)
            if cursor is not None and t <= cursor:
                if t < cursor:
                    report("OUT_OF_ORDER_CANDLE", t, position, position)
                elif text != last:
                    report("CANDLE_MUTATION_CONFLICT", t, position, position)
                continue
            if cursor is not None and t != cursor + self.interval:
                report("GAP", t, position, position, str(cursor + self.interval))
                continue
            raw = int(rule.step(*ohlcv))
            cursor, last = t, text
            after = raw if self.target or raw else position
            if after != position:
                report("EVENT", t, position, after)
                position = after
        self.state.update((cursor, position, last, pickle.dumps(rule)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEP_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def strategy_stream(bars: DataFrame, strategy_id: str, make: Callable, interval_ms: int, target: bool = False) -> DataFrame:
    """Event, gap and error rows of one strategy over a stream of closed bars."""
    return bars.groupBy("symbol", "timeframe").transformWithStateInPandas(
        statefulProcessor=StrategyStep(strategy_id, make, interval_ms, target), outputStructType=STEP_SCHEMA,
        outputMode="Append", timeMode="None")


class ChannelBreak:
    """Close beyond the range of the last bars: bounded state, for streams."""

    def __init__(self, bars: int = 20):
        self.bars = bars
        self.past: list[tuple[float, float]] = []

    def step(self, o, h, l, c, v) -> int:
        sig = 0
        if len(self.past) == self.bars:
            sig = 1 if c > max(x for x, _ in self.past) else -1 if c < min(y for _, y in self.past) else 0
        self.past = [*self.past, (h, l)][-self.bars:]
        return sig


class SweepReclaim:
    """Range sweep with reclaim, ATR by recurrence: bounded state, for streams."""

    def __init__(self, bars: int = 24, threshold: float = 0.05, atr: int = 14):
        from barlight.functions.recurrences import Rma

        self.bars, self.k, self.atr, self.c = bars, threshold, Rma(atr), None
        self.past: list[tuple[float, float]] = []

    def step(self, o, h, l, c, v) -> int:
        tr = h - l if self.c is None else max(h - l, abs(h - self.c), abs(l - self.c))
        a, self.c, sig = self.atr.step(tr), c, 0
        if len(self.past) == self.bars and a == a and a > 0:
            hi, lo = max(x for x, _ in self.past), min(y for _, y in self.past)
            if l < lo - self.k * a and c > lo:
                sig = 1
            elif h > hi + self.k * a and c < hi:
                sig = -1
        self.past = [*self.past, (h, l)][-self.bars:]
        return sig


# --- paper journal -------------------------------------------------------------------

JOURNAL_SCHEMA = ("underlying string, kind string, side int, entry_t bigint, entry_price double, exit_t bigint, "
                  "exit_price double, reason string, gross double, net double")
POSITION_SCHEMA = "side int, entry_t bigint, entry_price double, cohort string"


class PaperJournal(StatefulProcessor):
    """Paper position of one underlying.

    Intents of one micro-batch are applied in time order; an empty batch leaves
    the state as it is, so an outage carries positions forward.  A new cohort
    drops the position.
    """

    def __init__(self, cost: float):
        self.cost = cost

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", POSITION_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (underlying,) = key
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable", ignore_index=True)
        side, entry_t, entry_p, cohort = self.state.get() if self.state.exists() else (0, 0, 0.0, "")
        out = []
        for t, want, price, name in pdf[["t", "side", "price", "cohort"]].itertuples(index=False, name=None):
            if cohort and name != cohort:
                out.append((underlying, "COHORT_RESET", 0, None, None, int(t), None, None, None, None))
                side = 0
            cohort = name
            if want == side or not price > 0:
                continue
            if side:
                gross = price / entry_p - 1 if side > 0 else entry_p / price - 1
                reason = "REVERSE_SIGNAL" if want else "TARGET_FLAT"
                out.append((underlying, "CLOSE", side, entry_t, entry_p, int(t), price, reason, round(gross, 10),
                            round(round(gross, 10) - self.cost, 10)))
            side, entry_t, entry_p = int(want), int(t), float(price)
            if side:
                out.append((underlying, "OPEN", side, entry_t, entry_p, None, None, None, None, None))
        self.state.update((side, entry_t, entry_p, cohort))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in JOURNAL_SCHEMA.split(", ")])
        yield frame.astype({"entry_t": "Int64", "exit_t": "Int64", "side": "Int64"})

    def close(self) -> None:
        pass


def journal_stream(intents: DataFrame, cost: float = 0.0014) -> DataFrame:
    """Open and close rows of a stream of (underlying, t, side, price, cohort)."""
    return intents.groupBy("underlying").transformWithStateInPandas(
        statefulProcessor=PaperJournal(cost), outputStructType=JOURNAL_SCHEMA, outputMode="Append", timeMode="None")


def decide_and_append(snapshots: DataFrame, path: str, decide: Callable[[DataFrame, DataFrame], DataFrame]):
    """A ``foreachBatch`` function: as-of decision per event, appended under its batch id.

    Rewriting a batch replaces its folder, so a repeated batch adds nothing twice.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        decide(batch, snapshots).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run
