"""Trend and trailing-stop strategies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlight.functions.study import Study, _Make
from barlight.strategies import steps as P
from barlight.strategies.registry import TARGET, cross_over, cross_under, crosses, sided, strategy

CORE, OPEN = "core-v1", "tv-open-v1"


@strategy("pmax", "PMax Explorer", "trend_atr", CORE)
def pmax(s: Study) -> Column:
    s.true_range()
    s.scan(_Make(P.PMax), ["c", "tr"], ["pmax_ma", "pmax_line"])
    return crosses(s, "pmax_ma", "pmax_line")


@strategy("alphatrend", "AlphaTrend", "trend_volume_atr", CORE)
def alphatrend(s: Study) -> Column:
    s.true_range()
    s.sma("tr", 14)
    s.mfi(14)
    s.scan(_Make(P.AlphaTrend), ["sma_tr_14", "mfi_14", "h", "l"], ["at"])
    x, a, b, d = F.col("at"), s.lag("at"), s.lag("at", 2), s.lag("at", 3)
    return sided((a <= d) & (x > b), (a >= d) & (x < b))


def _two_bars_back(s: Study, ma: str, up: str, dn: str) -> Column:
    m, m1, i = F.col(ma), s.lag(ma), s.index()
    u2, u3, d2, d3 = s.lag(up, 2), s.lag(up, 3), s.lag(dn, 2), s.lag(dn, 3)
    return sided((i >= 4) & (m1 <= u3) & (m > u2), (i >= 4) & (m1 >= d3) & (m < d2))


@strategy("ott", "Optimized Trend Tracker", "adaptive_trend", CORE)
def ott(s: Study) -> Column:
    s.ott(2, 1.4, "ott")
    return _two_bars_back(s, "ott_ma", "ott_line", "ott_line")


@strategy("tott", "Twin Optimized Trend Tracker", "adaptive_trend", CORE)
def tott(s: Study) -> Column:
    _, line = s.ott(40, 1, "tott")
    s.row("tott_up", line * 1.006, ["tott_line"])
    s.row("tott_dn", line * 0.994, ["tott_line"])
    return _two_bars_back(s, "tott_ma", "tott_up", "tott_dn")


@strategy("mavilimw", "MavilimW", "smoothed_trend", CORE)
def mavilimw(s: Study) -> Column:
    src = "c"
    for p in (3, 5, 8, 13, 21, 34):
        s.wma(src, p)
        src = f"wma_{src}_{p}"
    x, x1, x2 = F.col(src), s.lag(src), s.lag(src, 2)
    return sided((x1 - x2 <= 0) & (x - x1 > 0), (x1 - x2 >= 0) & (x - x1 < 0))


def _ssl(s: Study) -> None:
    hi, lo = s.hma("h", 60), s.hma("l", 60)
    c = F.col("c")
    side = s.carry("ssl_side", F.when(c > hi, 1.0).when(c < lo, -1.0), ["hma_h_60", "hma_l_60"])
    s.row("ssl", F.when(side < 0, hi).otherwise(lo), ["ssl_side"])


@strategy("ssl_hybrid_flip", "SSL Hybrid — Flip Mode", "baseline_trend", OPEN)
def ssl_hybrid_flip(s: Study) -> Column:
    _ssl(s)
    return crosses(s, "c", "ssl")


@strategy("ssl_hybrid_qqe_flip", "SSL Hybrid + QQE — Flip Mode", "trend_momentum_filter", OPEN)
def ssl_hybrid_qqe_flip(s: Study) -> Column:
    _ssl(s)
    any_cross = cross_over(s, "c", "ssl") | cross_under(s, "c", "ssl")
    started = s.carry("ssl_on", F.when(any_cross, 1.0), ["ssl", "c_lag1", "ssl_lag1"])
    m1, f1 = s.qqe(3.0, "qqe3")
    m2, f2 = s.qqe(1.61, "qqe161")
    s.row("qqe3_off", f1 - 50, ["qqe3_fast"])
    mean, sd = s.mean_sd_finite("qqe3_off", 50)
    c, line = F.col("c"), F.col("ssl")
    on = (started == 1) & line.isNotNull()
    long = (c > line) & (m2 - 50 > 3) & (m1 - 50 > mean + 0.35 * sd) & (f2 - 50 > 0)
    short = (c < line) & (m2 - 50 < -3) & (m1 - 50 < mean - 0.35 * sd) & (f2 - 50 < 0)
    return sided(on & long, on & short)


@strategy("ut_bot_quantnomad", "UT Bot Strategy — QuantNomad", "atr_trailing_stop", OPEN)
def ut_bot(s: Study) -> Column:
    s.true_range()
    s.scan(_Make(P.TrailingStop), ["c", "tr"], ["ut_stop"])
    return crosses(s, "c", "ut_stop")


@strategy("chandelier_zlsma", "Chandelier Exit ZLSMA Strategy", "trend_breakout_filter", OPEN, mode=TARGET)
def chandelier_zlsma(s: Study) -> Column:
    s.true_range()
    s.row("ohlc", (F.col("o") + F.col("h") + F.col("l") + F.col("c")) / 4)
    s.lag("ohlc")
    s.lag("tr")
    s.row("ha", F.col("ohlc_lag1"), ["ohlc_lag1"])
    s.scan(_Make(P.ChandelierSide), ["ha", "tr_lag1"], ["ce_side"])
    s.zlsma("ha", 50)
    z = "zlsma_ha_50"
    s.row("ce_up", F.when(cross_over(s, "ha", z), 1.0).otherwise(0.0), ["ha_lag1", f"{z}_lag1"])
    s.row("ce_dn", F.when(cross_under(s, "ha", z), 1.0).otherwise(0.0), ["ha_lag1", f"{z}_lag1"])
    s.scan(_Make(P.FlatBetween), ["ce_side", "ce_up", "ce_dn"], ["ce_target"])
    return F.col("ce_target")
