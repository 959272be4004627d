"""A study adds named columns to bars, each computed once.

Columns are declared with the columns they read; ``frame()`` then places them in
the fewest stages: all window columns of one depth go to one ``withColumns``
over the same window (one sort serves them all).  Recurrences wait until everything that
does not need them is there, so that few grouped passes serve them all.  Undefined values are NULL throughout, so comparisons
with them are never true.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import recurrences as R
from barlight.operators import layout as L

BASE = ("symbol", "timeframe", "t", "o", "h", "l", "c", "v")


@dataclass
class _Def:
    kind: str  # window | row | scan | join
    place: tuple[int, int]  # recurrences on the longest path to it, then depth behind the last of them
    payload: object
    deps: tuple[str, ...] = ()
    back: int = 0
    ahead: int = 0


class Study:
    """Column registry over one bars table."""

    def __init__(self, bars: DataFrame, block_rows: int | None = None):
        """``block_rows`` cuts series into blocks of that many rows; see ``for_bars``."""
        self.block_rows = block_rows
        self.bars = L.into_blocks(bars, block_rows) if block_rows else L.spread(bars)
        self._defs: dict[str, _Def] = {}
        self._wanted: set[str] = set()

    @classmethod
    def for_bars(cls, bars: DataFrame, longest: int, block_rows: int = L.DEFAULT_BLOCK_ROWS) -> "Study":
        """One partition per series while ``longest`` (a checked bound) allows it."""
        return cls(bars, block_rows if longest > block_rows else None)

    # -- declaring columns --

    def _place(self, deps: Sequence[str], scan: bool = False) -> tuple[int, int]:
        rank = max((self._defs[d].place[0] for d in deps if d in self._defs), default=0)
        if scan:
            return rank + 1, 0
        same = [self._defs[d].place[1] for d in deps if d in self._defs and self._defs[d].place[0] == rank]
        return rank, max(same, default=0) + 1

    def _add(self, name: str, d: _Def) -> Column:
        if name not in self._defs:
            self._defs[name] = d
        return F.col(name)

    def row(self, name: str, expr: Column, deps: Sequence[str] = ()) -> Column:
        return self._add(name, _Def("row", self._place(deps), expr, tuple(deps)))

    def window(self, name: str, fn: Callable, deps: Sequence[str] = (), back: int = 0, ahead: int = 0) -> Column:
        """``fn(w)`` builds the column over the ordered series window."""
        return self._add(name, _Def("window", self._place(deps), fn, tuple(deps), back, ahead))

    def scan(self, make: Callable, inputs: Sequence[str], outputs: Sequence[str]) -> None:
        if outputs[0] not in self._defs:
            scan = L.Scan(make, tuple(inputs), tuple(outputs))
            for name in outputs:
                self._defs[name] = _Def("scan", self._place(inputs, scan=True), scan, tuple(inputs))

    def join(self, names: Sequence[str], fn: Callable[[DataFrame], DataFrame], deps: Sequence[str] = ()) -> None:
        """``fn`` adds ``names`` by a group aggregate joined back on its key."""
        if names[0] not in self._defs:
            place = self._place(deps)
            for name in names:
                self._defs[name] = _Def("join", place, fn, tuple(deps))

    def __contains__(self, name: str) -> bool:
        return name in self._defs

    # -- running --

    def frame(self) -> DataFrame:
        """Bars with every declared column."""
        df = self.bars
        for place in sorted({d.place for d in self._defs.values()}):
            at = {n: d for n, d in self._defs.items() if d.place == place}
            scans = list(dict.fromkeys(d.payload for d in at.values() if d.kind == "scan"))
            if scans:
                df = L.scan_series(df.drop(*self._spent(place)), scans)
                continue
            windows = {n: d for n, d in at.items() if d.kind == "window"}
            if windows:
                df = self._windows(df, windows)
            rows = {n: d.payload for n, d in at.items() if d.kind == "row"}
            if rows:
                df = df.withColumns(rows)
            for fn in dict.fromkeys(d.payload for d in at.values() if d.kind == "join"):
                df = fn(df)
        return df

    def _spent(self, place: tuple[int, int]) -> list[str]:
        """Array columns whose readers are all placed before ``place``."""
        last: dict[str, tuple[int, int]] = {}
        for d in self._defs.values():
            for name in d.deps:
                last[name] = max(last.get(name, d.place), d.place)
        return [n for n in self._defs if n.startswith("win_") and last.get(n, (0, 0)) < place]

    def _windows(self, df: DataFrame, windows: dict[str, _Def]) -> DataFrame:
        wide = df
        if self.block_rows is not None:
            wide = L.with_halo(df, self.block_rows, max(d.back for d in windows.values()), max(d.ahead for d in windows.values()))
        w = L.series_window(wide)
        out = wide.withColumns({n: d.payload(w) for n, d in windows.items()})
        return out if self.block_rows is None else out.where("_core").drop("_core")

    # -- shared helpers --

    def index(self) -> Column:
        if self.block_rows is not None:
            return F.col(L.INDEX)
        return self.window(L.INDEX, lambda w: (F.row_number().over(w) - 1).cast("long"))

    def lag(self, col: str, k: int = 1) -> Column:
        return self.window(f"{col}_lag{k}", lambda w: F.lag(col, k).over(w), [col], back=k)

    def next_open(self) -> None:
        for src in ("t", "o"):
            self.window(f"next_{src}", lambda w, s=src: F.lead(s).over(w), ahead=1)

    def carry(self, name: str, expr: Column, deps: Sequence[str]) -> Column:
        """Last defined value of ``expr`` up to and including the bar."""
        src = f"{name}_src"
        self.row(src, expr, deps)
        if self.block_rows is None:
            return self.window(name, lambda w: F.last(src, ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)), [src])
        self.scan(_Carry, [src], [name])
        return F.col(name)

    # -- moving statistics (C) --

    def true_range(self) -> Column:
        pc = self.lag("c")
        hl = F.col("h") - F.col("l")
        full = F.greatest(hl, F.abs(F.col("h") - pc), F.abs(F.col("l") - pc))
        return self.row("tr", F.when(pc.isNull(), hl).otherwise(full), ["c_lag1"])

    def typical(self) -> Column:
        return self.row("tp", (F.col("h") + F.col("l") + F.col("c")) / 3)

    def total(self, src: str, p: int) -> Column:
        """Sum of the last p values, NULL until p are defined."""
        name = f"sum_{src}_{p}"

        def build(w):
            f = w.rowsBetween(-(p - 1), 0)
            return F.when(F.count(src).over(f) == p, F.sum(src).over(f))

        return self.window(name, build, [src], back=p - 1)

    def sma(self, src: str, p: int) -> Column:
        s = self.total(src, p)
        return self.row(f"sma_{src}_{p}", s / p, [f"sum_{src}_{p}"])

    def recent(self, src: str, p: int) -> str:
        """Column with the last p values, oldest first; NULL until p are defined."""
        def build(w):
            f = w.rowsBetween(-(p - 1), 0)
            return F.when(F.count(src).over(f) == p, F.collect_list(src).over(f))

        self.window(f"win_{src}_{p}", build, [src], back=p - 1)
        return f"win_{src}_{p}"

    def chain(self, name: str, src: str, weights: Sequence[float], newest_first: bool = False) -> Column:
        """Weighted sum of the last values, added one by one in a fixed order."""
        xs = self.recent(src, len(weights))
        values = f"reverse(`{xs}`)" if newest_first else f"`{xs}`"
        table = ", ".join(f"{float(x)!r}D" for x in weights)
        total = F.expr(f"aggregate(zip_with({values}, array({table}), (a, b) -> a * b), 0D, (a, b) -> a + b)")
        return self.row(name, total, [xs])

    def stdev_pop(self, src: str, p: int, ordered: bool = False) -> Column:
        """Population deviation from the two power sums.

        ``ordered`` adds the values one by one, oldest first; whole-number
        inputs do not need it because their sums are exact in any order.
        """
        name = f"sd_{src}_{p}"
        if name in self:
            return F.col(name)
        self.row(f"{src}_sq", F.col(src) * F.col(src), [src])
        if ordered:
            s = self.chain(f"sum_{src}_{p}", src, [1] * p)
            q = self.chain(f"sum_{src}_sq_{p}", f"{src}_sq", [1] * p)
        else:
            s, q = self.total(src, p), self.total(f"{src}_sq", p)
        m = s / p
        # greatest() would turn an undefined variance into 0.
        spread = F.when(q.isNotNull(), F.greatest(F.lit(0.0), q / p - m * m))
        return self.row(name, F.sqrt(spread), [f"sum_{src}_{p}", f"sum_{src}_sq_{p}"])

    def mean_sd_finite(self, src: str, p: int) -> tuple[Column, Column]:
        """Mean and two-pass population deviation, values added oldest first."""
        mean, sd = f"mf_{src}_{p}", f"sf_{src}_{p}"
        xs = F.col(self.recent(src, p))
        self.row(mean, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / p, [f"win_{src}_{p}"])
        self.row(sd, F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - F.col(mean)) * (x - F.col(mean))) / p),
                 [mean])
        return F.col(mean), F.col(sd)

    def wma(self, src: str, p: int) -> Column:
        raw = self.chain(f"wsum_{src}_{p}", src, range(1, p + 1))
        return self.row(f"wma_{src}_{p}", raw / (p * (p + 1) / 2), [f"wsum_{src}_{p}"])

    def hma(self, src: str, p: int) -> Column:
        half, full = max(1, p // 2), p
        a, b = self.wma(src, half), self.wma(src, full)
        diff = f"hd_{src}_{p}"
        self.row(diff, F.lit(2.0) * a - b, [f"wma_{src}_{half}", f"wma_{src}_{full}"])
        root = max(1, int(math.floor(math.sqrt(p) + 0.5)))
        self.wma(diff, root)
        return self.row(f"hma_{src}_{p}", F.col(f"wma_{diff}_{root}"), [f"wma_{diff}_{root}"])

    def linreg(self, src: str, p: int, offset: int = 0) -> Column:
        """End point of the least-squares line over the last p values."""
        name = f"lr_{src}_{p}_{offset}"
        sx, sxx = (p - 1) * p / 2, (p - 1) * p * (2 * p - 1) / 6
        sy = self.chain(f"sy_{src}_{p}", src, [1] * p)
        sxy = self.chain(f"sxy_{src}_{p}", src, range(p))
        slope = (p * sxy - sx * sy) / (p * sxx - sx * sx)
        return self.row(name, (sy - slope * sx) / p + slope * (p - 1 - offset), [f"sy_{src}_{p}", f"sxy_{src}_{p}"])

    def zlsma(self, src: str, p: int) -> Column:
        a = self.linreg(src, p)
        b = self.linreg(f"lr_{src}_{p}_0", p)
        return self.row(f"zlsma_{src}_{p}", 2 * a - b, [f"lr_{src}_{p}_0", f"lr_lr_{src}_{p}_0_{p}_0"])

    def kernel(self, src: str, band: int) -> Column:
        """Causal Gaussian mean; the bandwidth is a third of the window."""
        w = [math.exp(-(k * k) / (2 * (band / 3) * (band / 3))) for k in range(band)]
        name = f"ksum_{src}_{band}"
        self.chain(name, src, w, newest_first=True)
        return self.row(f"kern_{src}_{band}", F.col(name) / F.lit(sum(w)), [name])

    def mfi(self, p: int) -> Column:
        tp = self.typical()
        prev = self.lag("tp")
        flow = tp * F.col("v")
        self.row("flow_up", F.when(tp > prev, flow).otherwise(0.0), ["tp", "tp_lag1"])
        self.row("flow_dn", F.when(tp < prev, flow).otherwise(0.0), ["tp", "tp_lag1"])
        up = self.chain(f"fu_{p}", "flow_up", [1] * p)
        dn = self.chain(f"fd_{p}", "flow_dn", [1] * p)
        value = F.when(dn == 0, F.lit(100.0)).otherwise(100 - F.lit(100.0) / (1 + up / dn))
        return self.row(f"mfi_{p}", value, [f"fu_{p}", f"fd_{p}"])

    def roc(self, src: str, p: int) -> Column:
        old = self.lag(src, p)
        return self.row(f"roc_{src}_{p}", F.when(old != 0, 100 * (F.col(src) / old - 1)), [f"{src}_lag{p}"])

    def stochastic(self, p: int = 14, smooth: int = 3) -> tuple[Column, Column]:
        def edge(fn, src):
            def build(w):
                f = w.rowsBetween(-(p - 1), 0)
                return F.when(F.count(src).over(f) == p, fn(src).over(f))
            return build

        hi = self.window(f"hi_{p}", edge(F.max, "h"), back=p - 1)
        lo = self.window(f"lo_{p}", edge(F.min, "l"), back=p - 1)
        k = F.when(hi == lo, F.lit(50.0)).otherwise(100 * (F.col("c") - lo) / (hi - lo))
        self.row(f"stoch_{p}", k, [f"hi_{p}", f"lo_{p}"])
        d = self.chain(f"stochsum_{p}_{smooth}", f"stoch_{p}", [1] * smooth)
        self.row(f"stoch_d_{p}", d / smooth, [f"stochsum_{p}_{smooth}"])
        return F.col(f"stoch_{p}"), F.col(f"stoch_d_{p}")

    def prior_high(self, p: int, src: str = "h") -> Column:
        """Highest of the p bars before this one."""
        return self._prior(F.max, src, p, "ph")

    def prior_low(self, p: int, src: str = "l") -> Column:
        return self._prior(F.min, src, p, "pl")

    def _prior(self, fn, src, p, tag) -> Column:
        def build(w):
            f = w.rowsBetween(-p, -1)
            return F.when(F.count(src).over(f) == p, fn(src).over(f))

        return self.window(f"{tag}_{src}_{p}", build, [src], back=p)

    # -- recurrences --

    def ema(self, src: str, p: int) -> Column:
        self.scan(_Make(R.Ema, p), [src], [f"ema_{src}_{p}"])
        return F.col(f"ema_{src}_{p}")

    def rma(self, src: str, p: int) -> Column:
        self.scan(_Make(R.Rma, p), [src], [f"rma_{src}_{p}"])
        return F.col(f"rma_{src}_{p}")

    def atr(self, p: int = 14) -> Column:
        self.true_range()
        return self.rma("tr", p)

    def rsi(self, src: str, p: int) -> Column:
        self.scan(_Make(R.Rsi, p), [src], [f"rsi_{src}_{p}"])
        return F.col(f"rsi_{src}_{p}")

    def macd(self) -> tuple[Column, Column]:
        self.scan(_Make(R.Macd), ["c"], ["macd", "macd_sig"])
        return F.col("macd"), F.col("macd_sig")

    def adx(self, p: int = 14) -> tuple[Column, Column, Column]:
        self.true_range()
        self.scan(_Make(R.Adx, p), ["tr", "h", "l"], ["adx", "pdi", "mdi"])
        return F.col("adx"), F.col("pdi"), F.col("mdi")

    def vidya(self, src: str, p: int) -> Column:
        self.scan(_Make(R.Vidya, p), [src], [f"vidya_{src}_{p}"])
        return F.col(f"vidya_{src}_{p}")

    def ott(self, p: int, pct: float, tag: str) -> tuple[Column, Column]:
        self.scan(_Make(R.Ott, p, pct), ["c"], [f"{tag}_ma", f"{tag}_line"])
        return F.col(f"{tag}_ma"), F.col(f"{tag}_line")

    def qqe(self, factor: float, tag: str) -> tuple[Column, Column]:
        self.scan(_Make(R.Qqe, 6, 5, factor), ["c"], [f"{tag}_ma", f"{tag}_fast"])
        return F.col(f"{tag}_ma"), F.col(f"{tag}_fast")

    def supertrend(self, p: int = 10, mult: float = 3.0) -> tuple[Column, Column]:
        self.atr(p)
        self.scan(_Make(R.SuperTrend, mult), [f"rma_tr_{p}", "h", "l", "c"], ["st_trend", "st_line"])
        return F.col("st_trend"), F.col("st_line")

    # -- levels --

    def pivot_marks(self, left: int, right: int) -> tuple[Column, Column]:
        """Strict extremum ``right`` bars ago, shown on its confirming bar only."""
        def mark(src, fn, beats):
            def build(w):
                mid = F.lag(src, right).over(w)
                old = fn(src).over(w.rowsBetween(-(left + right), -(right + 1)))
                new = fn(src).over(w.rowsBetween(-(right - 1), 0))
                full = F.count(src).over(w.rowsBetween(-(left + right), 0)) == left + right + 1
                return F.when(full & beats(mid, old) & beats(mid, new), mid)
            return build

        reach = left + right
        hi = self.window(f"pvh_{left}_{right}", mark("h", F.max, lambda a, b: a > b), back=reach)
        lo = self.window(f"pvl_{left}_{right}", mark("l", F.min, lambda a, b: a < b), back=reach)
        return hi, lo

    def pivots(self, left: int, right: int) -> tuple[Column, Column]:
        """Last confirmed high and low pivot, carried forward."""
        hi, lo = self.pivot_marks(left, right)
        return (self.carry(f"res_{left}_{right}", hi, [f"pvh_{left}_{right}"]),
                self.carry(f"sup_{left}_{right}", lo, [f"pvl_{left}_{right}"]))

    def _daily(self, names: Sequence[str], deps: Sequence[str] = ()) -> tuple[Column, ...]:
        """Columns read from one table of UTC days, joined to the bars once for all of them."""
        self._wanted.update(names)
        self.join(names, self._with_days, deps)
        return tuple(F.col(n) for n in names)

    def prior_period(self, unit: str) -> tuple[Column, Column, Column]:
        """High, low and close of the previous observed day, week or month."""
        return self._daily([f"{unit}_h", f"{unit}_l", f"{unit}_c"])

    def profile(self) -> tuple[Column, Column, Column]:
        """Point of control and value area of the previous observed UTC day."""
        return self._daily(["poc", "vah", "val"])

    def session_range(self, start: int, end: int) -> tuple[Column, Column]:
        """The day's range inside the UTC hours, known once the session is over."""
        names = [f"ses_{start}_{end}_h", f"ses_{start}_{end}_l"]
        cols = self._daily([f"{n}_day" for n in names])
        ready = utc_hour() >= end
        for n, c in zip(names, cols):
            self.row(n, F.when(ready, c), [f"{n}_day"])
        return F.col(names[0]), F.col(names[1])

    def _with_days(self, df: DataFrame) -> DataFrame:
        bars, by = self.bars, [k for k in L.series_keys(self.bars) if k != L.BLOCK]
        sessions = sorted({tuple(int(x) for x in n.split("_")[1:3]) for n in self._wanted if n.startswith("ses_")})
        inside = {(a, b): (utc_hour() >= a) & (utc_hour() < b) for a, b in sessions}
        days = bars.groupBy(*by, period_key("day").alias("_day")).agg(
            F.max("h").alias("_h"), F.min("l").alias("_l"), F.max_by("c", "t").alias("_c"),
            *[F.max(F.when(on, F.col("h"))).alias(f"ses_{a}_{b}_h_day") for (a, b), on in inside.items()],
            *[F.min(F.when(on, F.col("l"))).alias(f"ses_{a}_{b}_l_day") for (a, b), on in inside.items()])
        w = Window.partitionBy(*by).orderBy("_day")
        days = days.withColumns({"day_h": F.lag("_h").over(w), "day_l": F.lag("_l").over(w), "day_c": F.lag("_c").over(w)})
        for unit in ("week", "month"):
            if any(n.startswith(f"{unit}_") for n in self._wanted):
                # Rank of the observed period; the frame of the rank before is the previous one.
                days = days.withColumn("_p", F.dense_rank().over(Window.partitionBy(*by).orderBy(period_of_day(unit))))
                f = Window.partitionBy(*by).orderBy("_p").rangeBetween(-1, -1)
                days = days.withColumns({f"{unit}_h": F.max("_h").over(f), f"{unit}_l": F.min("_l").over(f),
                                         f"{unit}_c": F.max_by("_c", "_day").over(f)})
        if "poc" in self._wanted:
            days = days.join(_profiles(bars, by), [*by, "_day"], "left")
        table = days.select(*by, "_day", *sorted(self._wanted))
        return df.withColumn("_day", period_key("day")).join(table, [*by, "_day"], "left").drop("_day")


class _Make:
    """A picklable factory with its arguments."""

    def __init__(self, cls, *args):
        self.cls, self.args = cls, args

    def __call__(self):
        return self.cls(*self.args)


class _Carry:
    def __init__(self):
        self.x = math.nan

    def step(self, x: float) -> float:
        if math.isfinite(x):
            self.x = x
        return self.x

    levels = 1

    def values(self, x: np.ndarray) -> np.ndarray:
        held = np.concatenate([[self.x], x])
        at = np.maximum.accumulate(np.where(np.isfinite(held), np.arange(len(held)), 0))
        self.x = float(held[at[-1]])
        return held[at][1:]

    def summary(self, level: int, x: np.ndarray) -> float:
        known = x[np.isfinite(x)]
        return float(known[-1]) if len(known) else math.nan

    def advance(self, level: int, summary: float) -> None:
        self.step(summary)


def utc_hour() -> Column:
    return F.floor(F.pmod(F.col("t"), F.lit(86_400_000)) / 3_600_000)


def period_key(unit: str) -> Column:
    """Integer number of the UTC day, Monday week or month of ``t``."""
    day = F.floor(F.col("t") / 86_400_000)
    if unit == "day":
        return day.cast("long")
    if unit == "week":
        return F.floor((F.col("t") - 345_600_000) / 604_800_000).cast("long")
    stamp = F.timestamp_millis("t")
    return (F.year(stamp) * 12 + F.month(stamp) - 1).cast("long")


def period_of_day(unit: str) -> Column:
    """Number of the Monday week or month of day number ``_day``."""
    if unit == "week":
        return F.floor((F.col("_day") - 4) / 7)
    date = F.date_from_unix_date(F.col("_day").cast("int"))
    return F.year(date) * 12 + F.month(date) - 1


def _profiles(bars: DataFrame, by: list[str], bins: int = 24, share: float = 0.70) -> DataFrame:
    """Point of control and value area of each day's previous observed day.

    The area takes bins by falling volume until the bins before hold the share.
    """
    day = period_key("day")
    rows = bars.select(*by, day.alias("_day"), "h", "l", "v", ((F.col("h") + F.col("l") + F.col("c")) / 3).alias("tp"))
    span = rows.groupBy(*by, "_day").agg(F.max("h").alias("hi"), F.min("l").alias("lo"))
    step = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("tp") - F.col("lo")) / step)))
    held = (
        rows.join(span, [*by, "_day"])
        .where(F.col("hi") > F.col("lo"))
        .groupBy(*by, "_day", "hi", "lo", bin_no.alias("bin"))
        .agg(F.sum(F.greatest(F.lit(0.0), F.col("v"))).alias("vol"))
    )
    # At most `bins` rows per day from here on.
    ranked = Window.partitionBy(*by, "_day").orderBy(F.desc("vol"), "bin")
    whole = Window.partitionBy(*by, "_day")
    marked = held.select(
        "*",
        F.row_number().over(ranked).alias("rk"),
        F.coalesce(F.sum("vol").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("acc"),
        F.sum("vol").over(whole).alias("tot"),
    )
    inside = (F.col("tot") <= 0) | (F.col("acc") / F.col("tot") < share)
    full_day = F.col("tot") <= 0
    area = marked.groupBy(*by, "_day", "hi", "lo").agg(
        F.min_by("bin", "rk").alias("pk"),
        F.min(F.when(inside, F.col("bin"))).alias("b0"),
        F.max(F.when(inside, F.col("bin"))).alias("b1"),
        F.max(full_day).alias("empty"),
    )
    b0 = F.when(F.col("empty"), 0).otherwise(F.least("b0", "pk"))
    b1 = F.when(F.col("empty"), bins - 1).otherwise(F.greatest("b1", "pk"))
    pk = F.when(F.col("empty"), 0).otherwise(F.col("pk"))
    shaped = area.select(
        *by, "_day",
        (F.col("lo") + (pk + 0.5) * step).alias("poc"),
        (F.col("lo") + (b1 + 1) * step).alias("vah"),
        (F.col("lo") + b0 * step).alias("val"),
    )
    flat = span.where(F.col("hi") <= F.col("lo")).select(
        *by, "_day", ((F.col("hi") + F.col("lo")) / 2).alias("poc"), F.col("hi").alias("vah"), F.col("lo").alias("val"))
    days = Window.partitionBy(*by).orderBy("_day")
    return shaped.unionByName(flat).select(*by, "_day", *[F.lag(n).over(days).alias(n) for n in ("poc", "vah", "val")])
