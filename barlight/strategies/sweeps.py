"""Liquidity sweeps: a level is passed by a part of ATR and the close is back inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.study import Study
from barlight.strategies.levels import ATR, C, FAM, H, LO, O, V, V1, V25, body, live, lower_wick, upper_wick
from barlight.strategies.registry import confirm_within, sided, strategy

SW = "sweep-v1"


def sweep(s: Study, hi: Column, lo: Column, threshold: float = 0.05,
          extra: Callable[[Column], tuple[Column, Column]] | None = None) -> Column:
    """``extra(atr)`` gives one more condition for each side."""
    a, ok = live(s)
    long, short = ok & (LO() < lo - threshold * a) & (C() > lo), ok & (H() > hi + threshold * a) & (C() < hi)
    if extra is not None:
        up, dn = extra(a)
        long, short = long & up, short & dn
    return sided(long, short)


def range_sweep(s: Study, p: int, extra=None) -> Column:
    return sweep(s, s.prior_high(p), s.prior_low(p), extra=extra)


def _range(p: int):
    return lambda s: range_sweep(s, p)


for _p in (12, 24, 48, 96):
    strategy(f"swp_range{_p}_reclaim", f"Sweep Range-{_p} Reclaim", "liquidity_sweep", SW)(_range(_p))
strategy("sr_liquidity_sweep", "SR Liquidity Sweep + Reclaim", FAM, V1)(_range(24))
strategy("sr25_liquidity_sweep_reclaim", "SR25 Liquidity Sweep + Reclaim", FAM, V25)(_range(24))


def _period(unit: str):
    def build(s: Study) -> Column:
        hi, lo, _ = s.prior_period(unit)
        return sweep(s, hi, lo)
    return build


for _id, _name, _fam, _ver, _unit in (
    ("swp_prior_day", "Previous-Day High/Low Sweep", "liquidity_sweep", SW, "day"),
    ("swp_prior_week", "Previous-Week High/Low Sweep", "liquidity_sweep", SW, "week"),
    ("swp_prior_month", "Previous-Month High/Low Sweep", "liquidity_sweep", SW, "month"),
    ("sr_prior_day_sweep", "SR Prior-Day High/Low Sweep", FAM, V1, "day"),
    ("sr25_previous_day_sweep", "SR25 Previous-Day High/Low Sweep", FAM, V25, "day"),
):
    strategy(_id, _name, _fam, _ver)(_period(_unit))


@strategy("swp_pivot_sfp", "Confirmed-Pivot Swing Failure", "sfp", SW)
def pivot_sfp(s: Study) -> Column:
    return sweep(s, *s.pivots(3, 3))


@strategy("swp_pivot_sfp_body", "Pivot SFP + Body Confirmation", "sfp", SW)
def pivot_sfp_body(s: Study) -> Column:
    return sweep(s, *s.pivots(3, 3), extra=lambda a: (C() > O(), C() < O()))


@strategy("swp_volume_absorption", "Sweep + Volume Absorption", "liquidity_volume", SW)
def volume_absorption(s: Study) -> Column:
    m = s.sma("v", 20)
    return range_sweep(s, 24, lambda a: (V() >= 1.5 * m, V() >= 1.5 * m))


@strategy("swp_atr_expansion", "Sweep + ATR Expansion", "liquidity_volatility", SW)
def atr_expansion(s: Study) -> Column:
    return range_sweep(s, 24, lambda a: (H() - LO() >= 1.2 * a, H() - LO() >= 1.2 * a))


@strategy("swp_ema50_filter", "Sweep + EMA50 Direction Filter", "liquidity_trend", SW)
def ema_filter(s: Study) -> Column:
    e = s.ema("c", 50)
    return range_sweep(s, 24, lambda a: (C() > e, C() < e))


@strategy("swp_rsi_exhaustion", "Sweep + RSI Exhaustion", "liquidity_momentum", SW)
def rsi_exhaustion(s: Study) -> Column:
    x = s.rsi("c", 14)
    return range_sweep(s, 24, lambda a: (x <= 40, x >= 60))


@strategy("swp_wick_sfp", "Sweep + Wick Rejection", "sfp", SW)
def wick_sfp(s: Study) -> Column:
    def wicks(a):
        b = F.greatest(body(), 0.02 * a)
        return lower_wick() > 1.5 * b, upper_wick() > 1.5 * b
    return range_sweep(s, 24, wicks)


@strategy("swp_compression_reclaim", "Compression Sweep + Reclaim", "liquidity_volatility", SW)
def compression_reclaim(s: Study) -> Column:
    tight = s.prior_high(24) - s.prior_low(24)
    return range_sweep(s, 24, lambda a: (tight <= 4 * a, tight <= 4 * a))


def _after_sweep(s: Study, tag: str, bars: int, ok_long, ok_short, level_long, level_short, deps=()) -> Column:
    a, ok = live(s)
    hi, lo = s.prior_high(24), s.prior_low(24)
    long, short = ok & (LO() < lo - 0.05 * a) & (C() > lo), ok & (H() > hi + 0.05 * a) & (C() < hi)
    return confirm_within(s, tag, long, short, level_long, level_short, [ATR, "ph_h_24", "pl_l_24"],
                          lambda x: ok & ok_long(x), lambda x: ok & ok_short(x), bars, list(deps))


@strategy("swp_mss_confirm", "Sweep + Micro Structure Shift", "liquidity_structure", SW)
def mss_confirm(s: Study) -> Column:
    return _after_sweep(s, "mss", 3, lambda x: C() > x, lambda x: C() < x, H(), LO())


@strategy("swp_fvg_after", "Sweep + Post-Sweep FVG", "liquidity_fvg", SW)
def fvg_after(s: Study) -> Column:
    h2, l2 = s.lag("h", 2), s.lag("l", 2)
    return _after_sweep(s, "fvga", 4, lambda x: LO() > h2, lambda x: H() < l2, F.lit(0.0), F.lit(0.0),
                        ["h_lag2", "l_lag2"])


@strategy("swp_failed_breakout", "Two-Bar Failed Breakout Sweep", "turtle_soup", SW)
def failed_breakout(s: Study) -> Column:
    a, ok = live(s)
    hi, lo = s.prior_high(24), s.prior_low(24)
    hi1, lo1, p = s.lag("ph_h_24"), s.lag("pl_l_24"), s.lag("c")
    return sided(ok & (p < lo1 - 0.05 * a) & (C() > lo), ok & (p > hi1 + 0.05 * a) & (C() < hi))


def _session(start: int, end: int):
    return lambda s: sweep(s, *s.session_range(start, end))


strategy("swp_asia_range", "Asia Range Sweep", "session_liquidity", SW)(_session(0, 8))
strategy("swp_opening_range", "UTC Opening-Range Sweep", "session_liquidity", SW)(_session(0, 1))


# --- parametrised form ---------------------------------------------------------


def range_reclaim(study_bars: DataFrame, variants: DataFrame, lookbacks: list[int], atr_period: int = 14,
                  longest: int | None = None) -> DataFrame:
    """Non-zero signals of every variant of the range sweep.

    One pair of range columns per distinct lookback; the variants meet only the
    bars that sweep a level of their lookback, so the product stays sparse.
    """
    from barlight.operators import layout as L

    s = Study.for_bars(study_bars, L.longest_series(study_bars) if longest is None else longest)
    s.next_open()
    a = s.atr(atr_period)
    levels = F.array(*[F.struct(F.lit(p).alias("lookback"), s.prior_high(p).alias("hi"), s.prior_low(p).alias("lo"))
                       for p in lookbacks])
    bars = s.frame()
    keys = [k for k in ("symbol", "timeframe", "part", "block") if k in bars.columns]
    swept = (
        bars.where(a > 0)
        .select(*keys, "t", "next_t", "next_o", "o", "h", "l", "c", a.alias("a"), F.explode(levels).alias("r"))
        .where(((LO() < F.col("r.lo")) & (C() > F.col("r.lo"))) | ((H() > F.col("r.hi")) & (C() < F.col("r.hi"))))
        .select("*", F.col("r.lookback").alias("lookback"), F.col("r.hi").alias("hi"), F.col("r.lo").alias("lo")).drop("r")
    )
    rows = swept.join(variants, "lookback")
    k, w, m = F.col("thresholdAtr"), F.col("wickRatio"), F.col("minBarRangeAtr")
    atr = F.col("a")
    wide = (m <= 0) | (H() - LO() >= m * atr)
    b = F.greatest(body(), 0.02 * atr)
    plain = ~F.col("bodyConfirm")
    long = ((LO() < F.col("lo") - k * atr) & (C() > F.col("lo")) & (plain | (C() > O())) & wide
            & ((w <= 0) | (lower_wick() > w * b)) & (F.col("directionMode") != "short"))
    short = ((H() > F.col("hi") + k * atr) & (C() < F.col("hi")) & (plain | (C() < O())) & wide
             & ((w <= 0) | (upper_wick() > w * b)) & (F.col("directionMode") != "long"))
    return (rows.withColumn("sig", sided(long, short)).where("sig <> 0")
            .select(*keys, F.col("variantId").alias("strategy_id"), F.lit("REVERSAL").alias("mode"), "t", "sig",
                    "next_t", "next_o"))


def direction_filter(sig: Column, mode: str) -> Column:
    """Keep long targets, short targets or both."""
    if mode == "both":
        return sig
    return F.when(sig == (1 if mode == "long" else -1), sig).otherwise(0)
