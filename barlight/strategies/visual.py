"""Chart-indicator strategies.

Three of them (volatility fix, triangular mean, directional index) read a mean
of a column that starts undefined; here that mean starts where its inputs do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlight.functions.recurrences import AnchoredVwap
from barlight.functions.study import Study, _Make
from barlight.strategies.levels import C, H, LO, O, V
from barlight.strategies.registry import cross_over, cross_under, crosses, sided, strategy

VD = "visual-derived-v1"


def vis(id: str, name: str, family: str, **kw):
    return strategy(f"vis_{id}", f"{name} — Derived Adapter", family, VD, **kw)


def bands(s: Study, k: float, src: str = "c", p: int = 20) -> tuple[Column, Column]:
    m, d = s.sma(src, p), s.stdev_pop(src, p)
    return m - k * d, m + k * d


def reenter(s: Study, lo: Column, hi: Column) -> Column:
    p = s.lag("c")
    return sided((p < lo) & (C() >= lo), (p > hi) & (C() <= hi))


def turning(s: Study, x: str) -> Column:
    a, b, d = F.col(x), s.lag(x), s.lag(x, 2)
    return sided((a > b) & (b <= d), (a < b) & (b >= d))


@vis("bollinger_rsi_double", "Bollinger + RSI Double", "mean_reversion")
def bollinger_rsi(s: Study) -> Column:
    (lo, hi), x = bands(s, 2), s.rsi("c", 14)
    return sided((C() < lo) & (x < 30), (C() > hi) & (x > 70))


def _macd(s: Study, up: Column, dn: Column) -> Column:
    s.macd()
    return sided(cross_over(s, "macd", "macd_sig") & up, cross_under(s, "macd", "macd_sig") & dn)


@vis("macd_sma200", "MACD + SMA200", "trend_momentum")
def macd_sma(s: Study) -> Column:
    m = s.sma("c", 200)
    return _macd(s, C() > m, C() < m)


@vis("supertrend_10_3", "SuperTrend 10/3", "trend_atr")
def supertrend(s: Study) -> Column:
    trend, _ = s.supertrend()
    return F.when(trend != s.lag("st_trend"), trend).otherwise(0)


@vis("macd_rsi", "MACD + RSI", "momentum")
def macd_rsi(s: Study) -> Column:
    x = s.rsi("c", 14)
    return _macd(s, x > 50, x < 50)


@vis("hull_suite", "Hull Suite", "trend")
def hull(s: Study) -> Column:
    s.hma("c", 55)
    return turning(s, "hma_c_55")


@vis("ema_cross_9_21", "Single EMA Cross 9/21", "trend")
def ema_cross(s: Study) -> Column:
    s.ema("c", 9)
    s.ema("c", 21)
    return crosses(s, "ema_c_9", "ema_c_21")


@vis("golden_cross_50_200", "Golden Cross SMA50/200", "trend")
def golden(s: Study) -> Column:
    s.sma("c", 50)
    s.sma("c", 200)
    return crosses(s, "sma_c_50", "sma_c_200")


@vis("fractal_breakout", "Fractal Breakout", "breakout")
def fractal_break(s: Study) -> Column:
    hi, lo, p = s.prior_high(5), s.prior_low(5), s.lag("c")
    return sided((p <= hi) & (C() > hi), (p >= lo) & (C() < lo))


@vis("macd_stoch", "MACD + Stochastic", "momentum")
def macd_stoch(s: Study) -> Column:
    k, _ = s.stochastic()
    return _macd(s, k < 35, k > 65)


@vis("ema_slope_cross", "EMA Slope + EMA Cross", "trend")
def ema_slope(s: Study) -> Column:
    f, q = "ema_c_20", "ema_c_50"
    s.ema("c", 20)
    x = s.ema("c", 50)
    later = s.index() >= 2
    return sided(later & cross_over(s, f, q) & (x > s.lag(q)), later & cross_under(s, f, q) & (x < s.lag(q)))


@vis("squeeze_momentum", "Squeeze Momentum", "volatility_momentum")
def squeeze(s: Study) -> Column:
    d, a, m = s.stdev_pop("c", 20), s.atr(20), s.sma("c", 20)
    s.row("mom12", C() - s.lag("c", 12), ["c_lag12"])
    x, p = F.col("mom12"), s.lag("mom12")
    open_ = m.isNotNull() & (2 * d >= 1.5 * a)
    return sided(open_ & (x > 0) & (p <= 0), open_ & (x < 0) & (p >= 0))


@vis("adx_di", "ADX + DI", "trend_strength")
def adx_di(s: Study) -> Column:
    x, _, _ = s.adx(14)
    return sided((x >= 20) & cross_over(s, "pdi", "mdi"), (x >= 20) & cross_under(s, "pdi", "mdi"))


@vis("coppock", "Coppock Curve", "momentum")
def coppock(s: Study) -> Column:
    s.row("roc_sum", s.roc("c", 14) + s.roc("c", 11), ["roc_c_14", "roc_c_11"])
    s.wma("roc_sum", 10)
    return turning(s, "wma_roc_sum_10")


@vis("rsi_entries", "RSI Signals Entries", "momentum")
def rsi_entries(s: Study) -> Column:
    x = s.rsi("c", 14)
    p = s.lag("rsi_c_14")
    return sided((p <= 30) & (x > 30), (p >= 70) & (x < 70))


@vis("bb_mean_reversion", "Bollinger Mean Reversion", "mean_reversion")
def bb_mean(s: Study) -> Column:
    return reenter(s, *bands(s, 2))


@vis("vixfix_reversal", "Williams Vix Fix Reversal", "volatility")
def vixfix(s: Study) -> Column:
    top = s.prior_high(22, "c")
    x = s.row("wvf", F.when(top > 0, 100 * (top - LO()) / top), ["ph_c_22"])
    d = s.stdev_pop("wvf", 20, ordered=True)
    band = F.col("sum_wvf_20") / 20 + 2 * d
    p = s.lag("wvf")
    return sided((p > band) & (x <= band), (x > band) & (C() < O()))


def _beyond(s: Study, p: int, on: Column) -> Column:
    return sided(on & (C() > s.prior_high(p)), on & (C() < s.prior_low(p)))


@vis("sr_breaks", "Support & Resistance Breaks", "breakout")
def sr_breaks(s: Study) -> Column:
    return _beyond(s, 50, F.lit(True))


@vis("high_volume_box", "High Volume Boxes", "volume_breakout")
def volume_box(s: Study) -> Column:
    return _beyond(s, 20, V() >= 1.8 * s.sma("v", 20))


@vis("auto_range_breakout", "Auto Range Detector Breakout", "range_breakout")
def auto_range(s: Study) -> Column:
    return _beyond(s, 30, s.prior_high(30) - s.prior_low(30) <= 6 * s.atr(14))


@vis("fibonacci_bb", "Fibonacci Bollinger Bands", "volatility_breakout")
def fibonacci_bb(s: Study) -> Column:
    lo, hi = bands(s, 1.618)
    p = s.lag("c")
    return sided((p <= hi) & (C() > hi), (p >= lo) & (C() < lo))


@vis("ichimoku_hull", "Ichimoku + Hull", "trend_filter")
def ichimoku_hull(s: Study) -> Column:
    ten = (s.prior_high(9) + s.prior_low(9)) / 2
    kij = (s.prior_high(26) + s.prior_low(26)) / 2
    x = s.hma("c", 55)
    p = s.lag("hma_c_55")
    return sided((ten > kij) & (C() > x) & (x > p), (ten < kij) & (C() < x) & (x < p))


@vis("open_close_cross", "Open Close Cross", "price_action_trend")
def open_close(s: Study) -> Column:
    s.ema("o", 5)
    s.ema("c", 5)
    return crosses(s, "ema_c_5", "ema_o_5")


@vis("candlestick_reversal", "Candlestick Reversal Patterns", "price_action")
def candles(s: Study) -> Column:
    po, pc = s.lag("o"), s.lag("c")
    return sided((C() > O()) & (pc < po) & (O() <= pc) & (C() >= po), (C() < O()) & (pc > po) & (O() >= pc) & (C() <= po))


@vis("tma_overlay", "TMA Overlay Reversal", "mean_reversion")
def tma(s: Study) -> Column:
    s.sma("c", 10)
    m = s.chain("tma_sum", "sma_c_10", [1] * 10) / 10
    d = s.stdev_pop("c", 20)
    return reenter(s, m - 1.5 * d, m + 1.5 * d)


@vis("super_scalper", "Super Scalper 5m/15m", "scalping")
def scalper(s: Study) -> Column:
    s.ema("c", 8)
    s.ema("c", 21)
    x, a = s.rsi("c", 7), s.atr(7)
    wide = H() - LO() > 0.5 * a
    return sided(cross_over(s, "ema_c_8", "ema_c_21") & (x > 55) & wide,
                 cross_under(s, "ema_c_8", "ema_c_21") & (x < 45) & wide)


@strategy("vis_nadaraya_watson", "Nadaraya-Watson Envelope — Causal Derived Adapter", "statistical_mean_reversion", VD)
def nadaraya_watson(s: Study) -> Column:
    k = s.kernel("c", 30)
    s.row("nw_res", C() - k, ["kern_c_30"])
    d = s.stdev_pop("nw_res", 30, ordered=True)
    return reenter(s, k - 2 * d, k + 2 * d)


@vis("volume_delta_pivot", "Volume Delta Pivot Matrix", "volume_orderflow")
def volume_delta(s: Study) -> Column:
    x = s.row("vdelta", F.when(C() >= O(), 1.0).otherwise(-1.0) * V())
    m = F.abs(s.sma("vdelta", 20))
    later = s.index() >= 1
    return sided(later & (x > 2 * m) & (C() > O()), later & (x < -2 * m) & (C() < O()))


@vis("structure_vwap", "Structure-Anchored VWAP", "vwap")
def structure_vwap(s: Study) -> Column:
    a = s.atr(14)
    s.typical()
    hi, lo = s.prior_high(20), s.prior_low(20)
    s.row("xv_reset", F.when((C() > hi) | (C() < lo), 1.0).otherwise(0.0), ["ph_h_20", "pl_l_20"])
    s.scan(_Make(AnchoredVwap), ["xv_reset", "tp", "v"], ["xv"])
    x, p = F.col("xv"), s.lag("c")
    return sided((p <= x) & (C() > x + 0.05 * a), (p >= x) & (C() < x - 0.05 * a))
