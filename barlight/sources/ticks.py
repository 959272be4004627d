"""Bars from a tick table whose price is a running walk.

The price of a tick is ``start`` plus the running sum of signed steps of its
symbol.  A symbol may hold a third of all ticks, so ticks meet only inside
their own minute; from there on the work is on minute rows, whose number per
symbol is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators.bars import resample

START_PRICE = 10_000_000.0
MINUTE_MS = 60_000


def walk_minutes(events: DataFrame, start: float = START_PRICE) -> DataFrame:
    """1m bars of the walk built from ``event_type, user_id, value, ts, event_id``."""
    step = F.when(F.pmod("user_id", F.lit(2)) == 0, 1.0).otherwise(-1.0) * F.round(F.col("value") * 100)
    ticks = events.select(
        F.col("event_type").alias("symbol"),
        (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / MINUTE_MS) * MINUTE_MS).cast("long").alias("t"),
        "ts", "event_id", step.alias("step"),
    )
    inside = Window.partitionBy("symbol", "t").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct("ts", "event_id")
    minutes = (
        ticks.withColumn("p", F.sum("step").over(inside))
        .groupBy("symbol", "t")
        .agg(F.min_by("p", at).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"),
             F.max_by("p", at).alias("c"), F.count("*").cast("double").alias("v"))
    )
    before = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    base = F.lit(start) + F.coalesce(F.sum("c").over(before), F.lit(0.0))
    based = minutes.withColumn("base", base)
    return based.select("symbol", F.lit("1m").alias("timeframe"), "t",
                        *[(F.col("base") + F.col(x)).alias(x) for x in ("o", "h", "l", "c")], "v")


def walk_bars(events: DataFrame, timeframe: str) -> DataFrame:
    return resample(walk_minutes(events), timeframe)


def ticks_to_bars(ticks: DataFrame, timeframe_ms: int) -> DataFrame:
    """Plain tick bars: ``symbol, ts, tie, price, size`` to OHLCV per bucket."""
    at = F.struct("ts", "tie")
    t = (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / timeframe_ms) * timeframe_ms).cast("long")
    return ticks.groupBy("symbol", t.alias("t")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", at).alias("c"), F.sum("size").alias("v"))
