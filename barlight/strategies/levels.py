"""Support and resistance strategies: pivots, ranges, zones, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.recurrences import AnchoredVwap
from barlight.functions.study import Study, _Make, period_key
from barlight.operators import layout as L
from barlight.strategies import steps as P
from barlight.strategies.registry import confirm_within, sided, strategy

FAM, V1, V25 = "support_resistance", "sr-v1", "sr25-v1"
ATR = "rma_tr_14"


def O() -> Column:  # noqa: E743
    return F.col("o")


def H() -> Column:
    return F.col("h")


def LO() -> Column:
    return F.col("l")


def C() -> Column:
    return F.col("c")


def V() -> Column:
    return F.col("v")


def body() -> Column:
    return F.abs(C() - O())


def width() -> Column:
    return F.greatest(F.lit(1e-12), H() - LO())


def lower_wick() -> Column:
    return F.least(O(), C()) - LO()


def upper_wick() -> Column:
    return H() - F.greatest(O(), C())


def live(s: Study) -> tuple[Column, Column]:
    """The bar's ATR and whether it can be used."""
    a = s.atr(14)
    return a, a > 0


@strategy("sr_pivot_bounce", "SR Pivot Bounce", FAM, V1)
def pivot_bounce(s: Study) -> Column:
    a, ok = live(s)
    r, u = s.pivots(3, 3)
    return sided(ok & (LO() <= u + 0.20 * a) & (C() > u) & (C() > O()), ok & (H() >= r - 0.20 * a) & (C() < r) & (C() < O()))


def _pivot_break(s: Study, k: float) -> tuple[Column, Column]:
    a, ok = live(s)
    r, u = s.pivots(3, 3)
    p = s.lag("c")
    return ok & (p <= r) & (C() > r + k * a), ok & (p >= u) & (C() < u - k * a)


@strategy("sr_pivot_breakout", "SR Pivot Breakout", FAM, V1)
@strategy("sr25_confirmed_pivot_breakout", "SR25 Confirmed Pivot Breakout", FAM, V25)
def pivot_breakout(s: Study) -> Column:
    return sided(*_pivot_break(s, 0.10))


def _retest(s: Study, tag: str, k: float, bars: int, ok_long, ok_short) -> Column:
    long, short = _pivot_break(s, k)
    a, ok = live(s)
    return confirm_within(
        s, tag, long, short, F.col("res_3_3"), F.col("sup_3_3"), ["res_3_3", "sup_3_3", ATR, "c_lag1"],
        lambda x: ok & ok_long(x, a), lambda x: ok & ok_short(x, a), bars)


@strategy("sr_break_retest", "SR Break + Retest", FAM, V1)
def break_retest(s: Study) -> Column:
    return _retest(
        s, "br", 0.10, 12,
        lambda x, a: (LO() <= x + 0.15 * a) & (LO() >= x - 0.35 * a) & (C() > x) & (C() > O()),
        lambda x, a: (H() >= x - 0.15 * a) & (H() <= x + 0.35 * a) & (C() < x) & (C() < O()))


@strategy("sr_level_flip", "SR Breakout Level Flip", FAM, V1)
def level_flip(s: Study) -> Column:
    return _retest(
        s, "lf", 0.08, 10,
        lambda x, a: (LO() <= x + 0.12 * a) & (C() > x + 0.03 * a),
        lambda x, a: (H() >= x - 0.12 * a) & (C() < x - 0.03 * a))


@strategy("sr25_breakout_retest", "SR25 Breakout + Retest", FAM, V25)
def breakout_retest(s: Study) -> Column:
    return _retest(
        s, "bo", 0.10, 12,
        lambda x, a: (LO() <= x + 0.18 * a) & (C() > x) & (C() > O()),
        lambda x, a: (H() >= x - 0.18 * a) & (C() < x) & (C() < O()))


@strategy("sr25_role_reversal_flip", "SR25 S/R Role-Reversal Level Flip", FAM, V25)
def role_reversal(s: Study) -> Column:
    return _retest(
        s, "rr", 0.08, 18,
        lambda x, a: (LO() <= x + 0.10 * a) & (C() >= x + 0.03 * a),
        lambda x, a: (H() >= x - 0.10 * a) & (C() <= x - 0.03 * a))


@strategy("sr_wick_rejection", "SR Wick Rejection", FAM, V1)
def wick_rejection(s: Study) -> Column:
    a, ok = live(s)
    hi, lo = s.prior_high(48), s.prior_low(48)
    b = F.greatest(body(), 0.02 * a)
    lw, uw = lower_wick(), upper_wick()
    return sided(ok & (LO() <= lo + 0.10 * a) & (C() > lo) & (lw > 1.5 * b) & (lw > 0.20 * a),
                 ok & (H() >= hi - 0.10 * a) & (C() < hi) & (uw > 1.5 * b) & (uw > 0.20 * a))


@strategy("sr_range_edge", "SR Range Edge Rejection", FAM, V1)
def range_edge(s: Study) -> Column:
    hi, lo, p = s.prior_high(72), s.prior_low(72), s.lag("c")
    w = hi - lo
    ok = w > 0
    return sided(ok & (LO() <= lo + 0.15 * w) & (C() > O()) & (C() > p), ok & (H() >= hi - 0.15 * w) & (C() < O()) & (C() < p))


def _beyond(s: Study, p: int, k: float) -> tuple[Column, Column, Column, Column, Column]:
    a, ok = live(s)
    hi, lo = s.prior_high(p), s.prior_low(p)
    return a, hi, lo, ok & (C() > hi + k * a), ok & (C() < lo - k * a)


@strategy("sr_compression_breakout", "SR Compression Breakout", FAM, V1)
def compression_breakout(s: Study) -> Column:
    a, hi, lo, up, dn = _beyond(s, 24, 0.05)
    tight = (hi - lo) <= 7 * a
    return sided(tight & up, tight & dn)


@strategy("sr_volume_breakout", "SR Volume-Confirmed Breakout", FAM, V1)
def volume_breakout(s: Study) -> Column:
    _, _, _, up, dn = _beyond(s, 50, 0.05)
    m = s.sma("v", 20)
    heavy = (m > 0) & (V() >= 1.20 * m)
    return sided(heavy & up, heavy & dn)


@strategy("sr25_fractal_cluster_rejection", "SR25 Fractal Cluster Zone Rejection", FAM, V25)
def fractal_cluster(s: Study) -> Column:
    s.atr(14)
    s.pivot_marks(2, 2)
    s.scan(_Make(P.PivotCluster), ["pvh_2_2", "pvl_2_2", ATR, "o", "h", "l", "c"], ["cluster"])
    return F.col("cluster")


@strategy("sr25_wick_confirmed_zone", "SR25 Wick Rejection at Confirmed Zone", FAM, V25)
def wick_zone(s: Study) -> Column:
    a, ok = live(s)
    r, u = s.pivots(3, 3)
    b = F.greatest(body(), 0.02 * a)
    return sided(ok & (F.abs(LO() - u) <= 0.25 * a) & (lower_wick() >= 1.5 * b) & (C() > u),
                 ok & (F.abs(H() - r) <= 0.25 * a) & (upper_wick() >= 1.5 * b) & (C() < r))


@strategy("sr25_liquidity_absorption", "SR25 Liquidity Sweep + Volume Absorption", FAM, V25)
def absorption(s: Study) -> Column:
    a, ok = live(s)
    hi, lo, m = s.prior_high(24), s.prior_low(24), s.sma("v", 20)
    on = ok & (m > 0) & (V() >= 1.5 * m) & (body() / width() <= 0.55)
    return sided(on & (LO() < lo - 0.05 * a) & (C() > lo), on & (H() > hi + 0.05 * a) & (C() < hi))


@strategy("sr25_week_month_sweep", "SR25 Previous-Week / Month Extreme Sweep", FAM, V25)
def week_month_sweep(s: Study) -> Column:
    a, ok = live(s)
    (wh, wl, _), (mh, ml, _) = s.prior_period("week"), s.prior_period("month")
    no = F.lit(False)
    low = [F.coalesce((LO() < x - 0.04 * a) & (C() > x), no) for x in (wl, ml)]
    high = [F.coalesce((H() > x + 0.04 * a) & (C() < x), no) for x in (wh, mh)]
    return sided(ok & (low[0] | low[1]), ok & (high[0] | high[1]))


@strategy("sr25_lsob", "SR25 Liquidity Sweep + Order Block", FAM, V25)
def lsob(s: Study) -> Column:
    s.atr(14)
    s.prior_high(24)
    s.prior_low(24)
    s.scan(_Make(P.SweepOrderBlock), ["ph_h_24", "pl_l_24", ATR, "o", "h", "l", "c"], ["lsob"])
    return F.col("lsob")


@strategy("sr25_impulse_ob_retest", "SR25 Impulse Order Block Retest", FAM, V25)
def impulse_block(s: Study) -> Column:
    s.atr(14)
    s.sma("v", 20)
    s.scan(_Make(P.ImpulseBlock), [ATR, "sma_v_20", "o", "h", "l", "c", "v"], ["impulse"])
    return F.col("impulse")


@strategy("sr25_fvg_first_touch", "SR25 Fair Value Gap First-Touch Rejection", FAM, V25)
def gap_touch(s: Study) -> Column:
    s.lag("h", 2)
    s.lag("l", 2)
    s.scan(_Make(P.GapTouch), ["h_lag2", "l_lag2", "h", "l", "c"], ["gap_touch"])
    return F.col("gap_touch")


@strategy("sr25_inverse_fvg", "SR25 Inverse Fair Value Gap", FAM, V25)
def gap_inverse(s: Study) -> Column:
    s.lag("h", 2)
    s.lag("l", 2)
    s.scan(_Make(P.GapInverse), ["h_lag2", "l_lag2", "h", "l", "c"], ["gap_inverse"])
    return F.col("gap_inverse")


@strategy("sr25_pdh_fvg_mss", "SR25 PDH/PDL Sweep + FVG/MSS", FAM, V25)
def pdh_fvg(s: Study) -> Column:
    dh, dl, _ = s.prior_period("day")
    h2, l2, i = s.lag("h", 2), s.lag("l", 2), s.index()
    h1, l1 = s.lag("h"), s.lag("l")
    up = (LO() > h2) | ((i >= 3) & (C() > F.greatest(h1, h2)))
    dn = (H() < l2) | ((i >= 3) & (C() < F.least(l1, l2)))
    return confirm_within(
        s, "pdh", (i >= 2) & (LO() < dl) & (C() > dl), (i >= 2) & (H() > dh) & (C() < dh), F.lit(0.0), F.lit(0.0),
        ["day_h", "day_l"], lambda _: up, lambda _: dn, 8,
        ["h_lag1", "h_lag2", "l_lag1", "l_lag2"], same_bar=True)


@strategy("sr25_supply_demand_retest", "SR25 RBD/DBR Supply-Demand Retest", FAM, V25)
def supply_demand(s: Study) -> Column:
    s.atr(14)
    s.prior_high(3)
    s.prior_low(3)
    s.scan(_Make(P.BaseRetest), [ATR, "ph_h_3", "pl_l_3", "h", "l", "c"], ["base"])
    return F.col("base")


@strategy("sr25_kernel_supply_demand", "SR25 Kernel/Volume-Scored Supply-Demand", FAM, V25)
def scored_zones(s: Study) -> Column:
    s.atr(14)
    s.pivot_marks(2, 2)
    s.sma("v", 20)
    s.lag("v", 2)
    s.lag("c", 2)
    s.scan(_Make(P.ScoredZones),
           ["pvh_2_2", "pvl_2_2", ATR, "sma_v_20", "v_lag2", "c_lag2", "h", "l", "c"], ["scored"])
    return F.col("scored")


def camarilla(s: Study) -> dict[str, Column]:
    h, l, c = s.prior_period("day")
    r = h - l
    return {"h3": c + r * 1.1 / 4, "l3": c - r * 1.1 / 4, "h4": c + r * 1.1 / 2, "l4": c - r * 1.1 / 2}


@strategy("sr25_camarilla_h3_l3", "SR25 Camarilla H3/L3 Mean Reversion", FAM, V25)
def camarilla_mean(s: Study) -> Column:
    x = camarilla(s)
    later = s.index() >= 1
    return sided(later & (LO() <= x["l3"]) & (C() > x["l3"]) & (C() < x["h4"]),
                 later & (H() >= x["h3"]) & (C() < x["h3"]) & (C() > x["l4"]))


@strategy("sr25_camarilla_h4_l4", "SR25 Camarilla H4/L4 Breakout", FAM, V25)
def camarilla_break(s: Study) -> Column:
    x, p = camarilla(s), s.lag("c")
    return sided((p <= x["h4"]) & (C() > x["h4"]), (p >= x["l4"]) & (C() < x["l4"]))


def central_range(s: Study) -> tuple[Column, Column, Column]:
    """Pivot, lower and upper line of the central pivot range."""
    h, l, c = s.prior_period("day")
    pivot, mid = (h + l + c) / 3, (h + l) / 2
    other = 2 * pivot - mid
    return pivot, F.least(mid, other), F.greatest(mid, other)


@strategy("sr25_narrow_cpr_breakout", "SR25 Narrow CPR Breakout", FAM, V25)
def narrow_range(s: Study) -> Column:
    a, ok = live(s)
    pivot, bc, tc = central_range(s)
    p = s.lag("c")
    on = ok & pivot.isNotNull() & ((tc - bc) / a <= 0.45)
    return sided(on & (p <= tc) & (C() > tc), on & (p >= bc) & (C() < bc))


@strategy("sr25_poc_mean_reversion", "SR25 Volume Profile POC Mean Reversion", FAM, V25)
def poc_mean(s: Study) -> Column:
    a, ok = live(s)
    x, _, _ = s.profile()
    return sided(ok & (C() < x - 0.6 * a) & (C() > O()), ok & (C() > x + 0.6 * a) & (C() < O()))


@strategy("sr25_value_area_80", "SR25 Value-Area Edge / 80% Rule", FAM, V25)
def value_area(s: Study) -> Column:
    _, vah, val = s.profile()
    p = s.lag("c")
    return sided((p < val) & (C() >= val), (p > vah) & (C() <= vah))


@strategy("sr25_naked_poc_revisit", "SR25 Naked POC Revisit", FAM, V25)
def naked_poc(s: Study) -> Column:
    a, ok = live(s)
    x, _, _ = s.profile()
    s.row("poc_hit", F.when(ok & (LO() <= x) & (H() >= x), 1), [ATR, "poc"])

    def first_of_day(df: DataFrame) -> DataFrame:
        by = [k for k in L.series_keys(df) if k != L.BLOCK]
        day = Window.partitionBy(*by, period_key("day")).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("poc_seen", F.count("poc_hit").over(day))

    s.join(["poc_seen"], first_of_day, ["poc_hit"])
    first = (F.col("poc_hit") == 1) & (F.col("poc_seen") == 0)
    return sided(first & (O() > x) & (C() > x) & (lower_wick() > 0.15 * a),
                 first & (O() < x) & (C() < x) & (upper_wick() > 0.15 * a))


@strategy("sr25_swing_anchored_vwap", "SR25 Swing-Anchored VWAP Rejection / Flip", FAM, V25)
def swing_vwap(s: Study) -> Column:
    a, ok = live(s)
    s.typical()
    hi, lo = s.pivot_marks(4, 4)
    marks = ["pvh_4_4", "pvl_4_4"]
    reset = s.row("sv_reset", F.when(hi.isNotNull() | lo.isNotNull(), 1.0).otherwise(0.0), marks)
    s.row("sv_v", F.greatest(F.lit(0.0), V()))
    side = s.carry("sv_side", F.when(lo.isNotNull(), 1.0).when(hi.isNotNull(), -1.0), marks)
    s.scan(_Make(AnchoredVwap), ["sv_reset", "tp", "sv_v"], ["sv"])
    x, p = F.col("sv"), s.lag("c")
    before = F.when(reset == 0, s.lag("sv"))
    return (
        F.when(ok & (side == 1) & (LO() <= x + 0.15 * a) & (C() > x) & (C() > O()), 1)
        .when(ok & (side == -1) & (H() >= x - 0.15 * a) & (C() < x) & (C() < O()), -1)
        .when(ok & (p <= before) & (C() > x + 0.08 * a), 1)
        .when(ok & (p >= before) & (C() < x - 0.08 * a), -1)
        .otherwise(0))


@strategy("sr25_trendline_breakout", "SR25 Multi-Touch Trendline Breakout", FAM, V25)
def trendlines(s: Study) -> Column:
    s.atr(14)
    s.pivot_marks(3, 3)
    s.scan(_Make(P.TrendLines), ["pvh_3_3", "pvl_3_3", ATR, "c"], ["trendline"])
    return F.col("trendline")


@strategy("sr25_donchian_breakout", "SR25 Donchian Dynamic S/R Breakout", FAM, V25)
def donchian(s: Study) -> Column:
    return sided(C() > s.prior_high(20), C() < s.prior_low(20))
