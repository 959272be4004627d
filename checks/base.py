"""What all checks share: tables, walk bars, output form, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.operators.bars import resample
from barlight.session import TIMEFRAME_MS, prepare
from barlight.sources.ticks import walk_minutes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must agree with it."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles to six places, arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(c.isNotNull(), F.concat_ws(",", c.cast("array<string>")))
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "15m") -> DataFrame:
    minutes = walk_minutes(ticks(spark, sf_dir))
    return minutes if timeframe == "1m" else resample(minutes, timeframe)


_BOUNDS: dict[tuple, int] = {}


def bound(spark: SparkSession, sf_dir: str, timeframe: str = "15m") -> int:
    """Most bars a series can have: the ticks' span over the timeframe, plus one.

    One min/max scan; bars of a series have distinct times, so this holds for
    any number of ticks.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BOUNDS:
        ts = F.unix_millis(F.col("ts").cast("timestamp"))
        lo, hi = table(spark, sf_dir, "events").agg(F.min(ts), F.max(ts)).first()
        _BOUNDS[key] = int(hi - lo)
    return _BOUNDS[key] // TIMEFRAME_MS[timeframe] + 2


# --- SQL ---------------------------------------------------------------------------


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def num(x: float) -> str:
    """A double literal (the exponent keeps it from being read as a decimal)."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def sql_ticks() -> str:
    return """ticks AS MATERIALIZED (
  SELECT event_type AS symbol, ts, event_id, epoch_us(ts) AS us,
    10000000.0 + sum((CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE -1.0 END) * round(value * 100))
      OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p
  FROM events)"""


def sql_bars(timeframe: str = "15m", name: str = "bars") -> str:
    ms = TIMEFRAME_MS[timeframe]
    return f"""{name} AS MATERIALIZED (
  SELECT symbol, '{timeframe}' AS timeframe, t, o, h, l, c, v, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i
  FROM (SELECT symbol, (us // {ms * 1000}) * {ms} AS t, first(CAST(p AS DOUBLE) ORDER BY ts, event_id) AS o, CAST(max(p) AS DOUBLE) AS h,
          CAST(min(p) AS DOUBLE) AS l, last(CAST(p AS DOUBLE) ORDER BY ts, event_id) AS c, CAST(count(*) AS DOUBLE) AS v
        FROM ticks GROUP BY 1, 2))"""


def walk(timeframe: str = "15m") -> str:
    return f"{sql_ticks()},\n{sql_bars(timeframe)}"


W = "(PARTITION BY symbol ORDER BY i)"


def frame(a: int, b: int, part: str = "symbol") -> str:
    def end(k: int) -> str:
        return f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"
    return f"(PARTITION BY {part} ORDER BY i ROWS BETWEEN {end(a)} AND {end(b)})"


def prior(fn: str, src: str, p: int) -> str:
    return f"CASE WHEN i >= {p} THEN {fn}({src}) OVER {frame(-p, -1)} END"


def lag_chain(src: str, weights: Iterable[float]) -> str:
    """Weighted sum, oldest first; NULL while one value is missing."""
    ws = list(weights)
    p = len(ws)
    terms = [f"lag({src}, {p - 1 - k}) OVER w * {num(x)}" for k, x in enumerate(ws)]
    return " + ".join(terms)


class Recur:
    """Columns of one recursive pass over rows ``x`` keyed by (symbol, i)."""

    def __init__(self):
        self.seed: list[str] = []
        self.step: list[str] = []
        self.value: list[str] = []

    def raw(self, name: str, seed: str, step: str, value: str | None = None) -> "Recur":
        self.seed.append(f"{seed} AS {name}")
        self.step.append(f"{step} AS {name}")
        self.value.append(f"{value or name} AS {name}")
        return self

    def ema(self, name: str, p: int, src: str) -> "Recur":
        a = 2 / (p + 1)
        return self.raw(name, f"x.{src}", f"{num(a)} * x.{src} + {num(1 - a)} * r.{name}")

    def rma(self, name: str, p: int, src: str) -> "Recur":
        return self.raw(
            name, f"x.{src}",
            f"CASE WHEN x.i < {p - 1} THEN r.{name} + x.{src} WHEN x.i = {p - 1} THEN (r.{name} + x.{src}) / {p} "
            f"ELSE (r.{name} * {p - 1} + x.{src}) / {p} END", f"CASE WHEN i >= {p - 1} THEN {name} END")

    def sql(self, src: str, rec: str, out: str) -> str:
        """Two tables: the raw recursion ``rec`` and ``out`` = src joined with the values."""
        return f"""{rec} AS (
  SELECT x.symbol, x.i, {', '.join(self.seed)} FROM {src} x WHERE x.i = 0
  UNION ALL
  SELECT x.symbol, x.i, {', '.join(self.step)} FROM {rec} r JOIN {src} x ON x.symbol = r.symbol AND x.i = r.i + 1),
{out} AS MATERIALIZED (SELECT b.*, {', '.join(f'q.{v.rsplit(" AS ", 1)[1]}' for v in self.value)}
  FROM {src} b JOIN (SELECT symbol, i, {', '.join(self.value)} FROM {rec}) q ON q.symbol = b.symbol AND q.i = b.i)"""
