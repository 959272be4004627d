"""Strategy rules restated in SQL, independent of the DataFrame code."""

from __future__ import annotations

import math

from checks.base import W, Recur, frame, lag_chain, num, prior, walk

LAGS = f"""x AS MATERIALIZED (
  SELECT *, lag(c) OVER w AS pc, lag(o) OVER w AS po, lag(h) OVER w AS h1, lag(l) OVER w AS l1, lag(h, 2) OVER w AS h2, lag(l, 2) OVER w AS l2,
    CASE WHEN i = 0 THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr,
    (h + l + c) / 3 AS tp, CASE WHEN i = 0 THEN 0 ELSE greatest(c - lag(c) OVER w, 0) END AS up,
    CASE WHEN i = 0 THEN 0 ELSE greatest(lag(c) OVER w - c, 0) END AS dn
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i))"""


def emit(rules: dict[str, tuple[str, str]], src: str) -> str:
    cells = ", ".join(
        f"{{'strategy_id': '{k}', 'sig': CASE WHEN {lo} THEN 1 WHEN {sh} THEN -1 ELSE 0 END}}" for k, (lo, sh) in rules.items())
    return (f"SELECT symbol, timeframe, u.strategy_id AS strategy_id, t, CAST(u.sig AS BIGINT) AS sig "
            f"FROM (SELECT symbol, timeframe, t, unnest([{cells}]) AS u FROM {src}) WHERE u.sig <> 0")


def emit_columns(cols: dict[str, str], src: str) -> str:
    cells = ", ".join(f"{{'strategy_id': '{k}', 'sig': CAST({v} AS BIGINT)}}" for k, v in cols.items())
    return (f"SELECT symbol, timeframe, u.strategy_id AS strategy_id, t, u.sig AS sig "
            f"FROM (SELECT symbol, timeframe, t, unnest([{cells}]) AS u FROM {src}) WHERE u.sig <> 0")


def ranges(ps) -> str:
    return ", ".join(f"{prior('max', 'h', p)} AS ph{p}, {prior('min', 'l', p)} AS pl{p}" for p in ps)


def pivots(n: int) -> str:
    def mark(src, fn, op):
        return (f"CASE WHEN i >= {2 * n} AND lag({src}, {n}) OVER {W} {op} {fn}({src}) OVER {frame(-2 * n, -n - 1)} "
                f"AND lag({src}, {n}) OVER {W} {op} {fn}({src}) OVER {frame(-n + 1, 0)} THEN lag({src}, {n}) OVER {W} END")
    return f"{mark('h', 'max', '>')} AS vh{n}, {mark('l', 'min', '<')} AS vl{n}"


def period(unit: str) -> tuple[str, str]:
    key = {"day": "t // 86400000", "week": "(t - 345600000) // 604800000",
           "month": "year(make_timestamp(t * 1000)) * 12 + month(make_timestamp(t * 1000))"}[unit]
    u = unit[0]
    cte = f"""{unit}s AS (SELECT symbol, k AS {u}k, lag(h) OVER (PARTITION BY symbol ORDER BY k) AS {u}h, lag(l) OVER (PARTITION BY symbol ORDER BY k) AS {u}l,
  lag(c) OVER (PARTITION BY symbol ORDER BY k) AS {u}c
  FROM (SELECT symbol, {key} AS k, max(h) AS h, min(l) AS l, arg_max(c, t) AS c FROM bars GROUP BY 1, 2))"""
    return cte, key


PROFILE = """spans AS (SELECT symbol, t // 86400000 AS d, max(h) AS hi, min(l) AS lo FROM bars GROUP BY 1, 2),
held AS (SELECT b.symbol, s.d, s.hi, s.lo, greatest(0, least(23, CAST(floor(((b.h + b.l + b.c) / 3 - s.lo) / ((s.hi - s.lo) / 24)) AS BIGINT))) AS bin,
   sum(v) AS vol FROM bars b JOIN spans s ON s.symbol = b.symbol AND s.d = b.t // 86400000 WHERE s.hi > s.lo GROUP BY 1, 2, 3, 4, 5),
marked AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY vol DESC, bin) AS rk,
   coalesce(sum(vol) OVER (PARTITION BY symbol, d ORDER BY vol DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc,
   sum(vol) OVER (PARTITION BY symbol, d) AS tot FROM held),
areas AS (SELECT symbol, d, hi, lo, arg_min(bin, rk) AS pk, least(min(bin) FILTER (acc / tot < 0.70), arg_min(bin, rk)) AS b0,
   greatest(max(bin) FILTER (acc / tot < 0.70), arg_min(bin, rk)) AS b1 FROM marked GROUP BY 1, 2, 3, 4),
profiles AS (SELECT symbol, d, lag(poc) OVER z AS poc, lag(vah) OVER z AS vah, lag(val) OVER z AS val FROM (
   SELECT symbol, d, lo + (pk + 0.5) * ((hi - lo) / 24) AS poc, lo + (b1 + 1) * ((hi - lo) / 24) AS vah, lo + b0 * ((hi - lo) / 24) AS val FROM areas
   UNION ALL SELECT symbol, d, (hi + lo) / 2, hi, lo FROM spans WHERE hi <= lo) WINDOW z AS (PARTITION BY symbol ORDER BY d))"""

ATR = Recur().rma("a", 14, "tr").sql("x", "ra", "xa")
BODY, LW, UW = "abs(c - o)", "(least(o, c) - l)", "(h - greatest(o, c))"


def sweep(hi: str, lo: str, k: float = 0.05, up: str = "true", dn: str = "true") -> tuple[str, str]:
    return (f"a > 0 AND l < {lo} - {k} * a AND c > {lo} AND ({up})", f"a > 0 AND h > {hi} + {k} * a AND c < {hi} AND ({dn})")


# --- ranges and sweeps ----------------------------------------------------------------

_ind = Recur().rma("a", 14, "tr").ema("e50", 50, "c").rma("g14", 14, "up").rma("s14", 14, "dn")
SWEEP_RULES = {
    **{f"swp_range{p}_reclaim": sweep(f"ph{p}", f"pl{p}") for p in (12, 24, 48, 96)},
    "sr_liquidity_sweep": sweep("ph24", "pl24"), "sr25_liquidity_sweep_reclaim": sweep("ph24", "pl24"),
    "swp_volume_absorption": sweep("ph24", "pl24", 0.05, "v >= 1.5 * v20", "v >= 1.5 * v20"),
    "swp_atr_expansion": sweep("ph24", "pl24", 0.05, "h - l >= 1.2 * a", "h - l >= 1.2 * a"),
    "swp_ema50_filter": sweep("ph24", "pl24", 0.05, "c > e50", "c < e50"),
    "swp_rsi_exhaustion": sweep("ph24", "pl24", 0.05, "r14 <= 40", "r14 >= 60"),
    "swp_wick_sfp": sweep("ph24", "pl24", 0.05, f"{LW} > 1.5 * greatest({BODY}, 0.02 * a)", f"{UW} > 1.5 * greatest({BODY}, 0.02 * a)"),
    "swp_compression_reclaim": sweep("ph24", "pl24", 0.05, "ph24 - pl24 <= 4 * a", "ph24 - pl24 <= 4 * a"),
    "swp_failed_breakout": ("a > 0 AND pc < lag_pl24 - 0.05 * a AND c > pl24", "a > 0 AND pc > lag_ph24 + 0.05 * a AND c < ph24"),
    "sr25_liquidity_absorption": sweep(
        "ph24", "pl24", 0.05, f"v20 > 0 AND v >= 1.5 * v20 AND {BODY} / greatest(1e-12, h - l) <= 0.55",
        f"v20 > 0 AND v >= 1.5 * v20 AND {BODY} / greatest(1e-12, h - l) <= 0.55"),
}
RSI = "CASE WHEN s14 = 0 THEN 100 WHEN g14 = 0 THEN 0 ELSE 100 - 100 / (1 + g14 / s14) END"
SWEEPS_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{_ind.sql('x', 'ra', 'xa')},
y AS MATERIALIZED (SELECT *, {ranges((12, 24, 48, 96))}, CASE WHEN i >= 19 THEN (sum(v) OVER {frame(-19, 0)}) / 20 END AS v20,
  CASE WHEN g14 IS NOT NULL THEN {RSI} END AS r14 FROM xa),
f AS (SELECT *, lag(ph24) OVER {W} AS lag_ph24, lag(pl24) OVER {W} AS lag_pl24 FROM y)
{emit(SWEEP_RULES, 'f')}"""

# --- calendar levels and sessions --------------------------------------------------------

_d, _dk = period("day")
_w, _wk = period("week")
_m, _mk = period("month")


def _any(*conds: str) -> str:
    return "a > 0 AND (" + " OR ".join(f"coalesce({c}, false)" for c in conds) + ")"


CALENDAR_RULES = {
    "swp_prior_day": sweep("dh", "dl"), "sr_prior_day_sweep": sweep("dh", "dl"), "sr25_previous_day_sweep": sweep("dh", "dl"),
    "swp_prior_week": sweep("wh", "wl"), "swp_prior_month": sweep("mh", "ml"),
    "sr25_week_month_sweep": (_any("l < wl - 0.04 * a AND c > wl", "l < ml - 0.04 * a AND c > ml"),
                              _any("h > wh + 0.04 * a AND c < wh", "h > mh + 0.04 * a AND c < mh")),
    "swp_asia_range": sweep("ah", "al"), "swp_opening_range": sweep("oh", "ol"),
    "sr25_camarilla_h3_l3": ("i >= 1 AND l <= l3 AND c > l3 AND c < h4", "i >= 1 AND h >= h3 AND c < h3 AND c > l4"),
    "sr25_camarilla_h4_l4": ("pc <= h4 AND c > h4", "pc >= l4 AND c < l4"),
    "sr25_narrow_cpr_breakout": ("a > 0 AND (tc - bc) / a <= 0.45 AND pc <= tc AND c > tc", "a > 0 AND (tc - bc) / a <= 0.45 AND pc >= bc AND c < bc"),
}
CALENDAR_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
{_d},
{_w},
{_m},
y AS (SELECT b.*, dh, dl, dc, wh, wl, mh, ml, (b.t // 3600000) % 24 AS hr,
  max(CASE WHEN (b.t // 3600000) % 24 < 8 THEN h END) OVER dd AS ah0, min(CASE WHEN (b.t // 3600000) % 24 < 8 THEN l END) OVER dd AS al0,
  max(CASE WHEN (b.t // 3600000) % 24 < 1 THEN h END) OVER dd AS oh0, min(CASE WHEN (b.t // 3600000) % 24 < 1 THEN l END) OVER dd AS ol0
  FROM xa b LEFT JOIN days ON days.symbol = b.symbol AND dk = b.{_dk}
  LEFT JOIN weeks ON weeks.symbol = b.symbol AND wk = {_wk.replace('t -', 'b.t -')}
  LEFT JOIN months ON months.symbol = b.symbol AND mk = {_mk.replace('(t ', '(b.t ')}
  WINDOW dd AS (PARTITION BY b.symbol, b.t // 86400000 ORDER BY b.i)),
f AS (SELECT *, CASE WHEN hr >= 8 THEN ah0 END AS ah, CASE WHEN hr >= 8 THEN al0 END AS al, CASE WHEN hr >= 1 THEN oh0 END AS oh, CASE WHEN hr >= 1 THEN ol0 END AS ol,
  dc + (dh - dl) * 1.1 / 4 AS h3, dc - (dh - dl) * 1.1 / 4 AS l3, dc + (dh - dl) * 1.1 / 2 AS h4, dc - (dh - dl) * 1.1 / 2 AS l4,
  least((dh + dl) / 2, 2 * ((dh + dl + dc) / 3) - (dh + dl) / 2) AS bc, greatest((dh + dl) / 2, 2 * ((dh + dl + dc) / 3) - (dh + dl) / 2) AS tc FROM y)
{emit(CALENDAR_RULES, 'f')}"""

# --- pivots and ranges ----------------------------------------------------------------------

PIVOT_BREAK = ("a > 0 AND pc <= r AND c > r + 0.10 * a", "a > 0 AND pc >= s AND c < s - 0.10 * a")
LEVEL_RULES = {
    "sr_pivot_bounce": ("a > 0 AND l <= s + 0.20 * a AND c > s AND c > o", "a > 0 AND h >= r - 0.20 * a AND c < r AND c < o"),
    "sr_pivot_breakout": PIVOT_BREAK, "sr25_confirmed_pivot_breakout": PIVOT_BREAK,
    "sr_wick_rejection": (f"a > 0 AND l <= pl48 + 0.10 * a AND c > pl48 AND {LW} > 1.5 * greatest({BODY}, 0.02 * a) AND {LW} > 0.20 * a",
                          f"a > 0 AND h >= ph48 - 0.10 * a AND c < ph48 AND {UW} > 1.5 * greatest({BODY}, 0.02 * a) AND {UW} > 0.20 * a"),
    "sr_range_edge": ("ph72 > pl72 AND l <= pl72 + 0.15 * (ph72 - pl72) AND c > o AND c > pc", "ph72 > pl72 AND h >= ph72 - 0.15 * (ph72 - pl72) AND c < o AND c < pc"),
    "sr_compression_breakout": ("a > 0 AND ph24 - pl24 <= 7 * a AND c > ph24 + 0.05 * a", "a > 0 AND ph24 - pl24 <= 7 * a AND c < pl24 - 0.05 * a"),
    "sr_volume_breakout": ("a > 0 AND v20 > 0 AND v >= 1.2 * v20 AND c > ph50 + 0.05 * a", "a > 0 AND v20 > 0 AND v >= 1.2 * v20 AND c < pl50 - 0.05 * a"),
    "sr25_wick_confirmed_zone": (f"a > 0 AND abs(l - s) <= 0.25 * a AND {LW} >= 1.5 * greatest({BODY}, 0.02 * a) AND c > s",
                                 f"a > 0 AND abs(h - r) <= 0.25 * a AND {UW} >= 1.5 * greatest({BODY}, 0.02 * a) AND c < r"),
    "swp_pivot_sfp": sweep("r", "s"), "swp_pivot_sfp_body": sweep("r", "s", 0.05, "c > o", "c < o"),
    "sr25_donchian_breakout": ("c > ph20", "c < pl20"),
    "sr25_poc_mean_reversion": ("a > 0 AND c < poc - 0.6 * a AND c > o", "a > 0 AND c > poc + 0.6 * a AND c < o"),
    "sr25_value_area_80": ("pc < val AND c >= val", "pc > vah AND c <= vah"),
    "sr25_naked_poc_revisit": (f"hit AND seen = 0 AND o > poc AND c > poc AND {LW} > 0.15 * a", f"hit AND seen = 0 AND o < poc AND c < poc AND {UW} > 0.15 * a"),
}
PIVOTED = f"""y AS MATERIALIZED (SELECT *, {pivots(3)} FROM xa),
z AS MATERIALIZED (SELECT *, last_value(vh3 IGNORE NULLS) OVER {frame(-100000000, 0).replace('100000000 PRECEDING', 'UNBOUNDED PRECEDING')} AS r,
  last_value(vl3 IGNORE NULLS) OVER {frame(-100000000, 0).replace('100000000 PRECEDING', 'UNBOUNDED PRECEDING')} AS s FROM y)"""
LEVELS_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
{PIVOTED},
{PROFILE},
q0 AS (SELECT b.*, poc, vah, val FROM z b LEFT JOIN profiles p ON p.symbol = b.symbol AND p.d = b.t // 86400000),
q AS (SELECT *, coalesce(a > 0 AND l <= poc AND h >= poc, false) AS hit, {ranges((20, 24, 48, 50, 72))},
  CASE WHEN i >= 19 THEN (sum(v) OVER {frame(-19, 0)}) / 20 END AS v20 FROM q0),
f AS (SELECT *, coalesce(count(*) FILTER (hit) OVER (PARTITION BY symbol, t // 86400000 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM q)
{emit(LEVEL_RULES, 'f')}"""

# --- pending confirmations as sequential state machines -----------------------------------------


def pend(rec: Recur, n: str, long: str, short: str, lv_long: str, lv_short: str, ok_long: str, ok_short: str, bars: int,
         gate: str = "x.a > 0", same_bar: bool = False) -> None:
    """Side, level and expiry of one pending order, and its signal, bar by bar."""
    L, S = f"({gate}) AND ({long})", f"({gate}) AND ({short})"
    live = f"x.i <= r.{n}_e"
    if same_bar:
        side = f"(CASE WHEN {L} THEN 1 WHEN {S} THEN -1 WHEN {live} THEN r.{n}_d ELSE 0 END)"
        hit_l, hit_s = f"{side} = 1 AND ({ok_long})", f"{side} = -1 AND ({ok_short})"
        rec.raw(f"{n}_e", "-1", f"CASE WHEN {L} OR {S} THEN x.i + {bars} ELSE r.{n}_e END")
        rec.raw(f"{n}_d", "0", f"CASE WHEN coalesce({hit_l} OR {hit_s}, false) THEN 0 ELSE {side} END")
        rec.raw(f"{n}_s", "0", f"CASE WHEN {hit_l} THEN 1 WHEN {hit_s} THEN -1 ELSE 0 END")
        return
    lv = f"r.{n}_l"
    wait = f"({gate}) AND NOT coalesce({long}, false) AND NOT coalesce({short}, false) AND {live}"
    hit_l, hit_s = f"{wait} AND r.{n}_d = 1 AND ({ok_long.replace('LV', lv)})", f"{wait} AND r.{n}_d = -1 AND ({ok_short.replace('LV', lv)})"
    rec.raw(f"{n}_e", "-1", f"CASE WHEN {L} OR {S} THEN x.i + {bars} ELSE r.{n}_e END")
    rec.raw(f"{n}_l", "CAST(NULL AS DOUBLE)", f"CASE WHEN {L} THEN {lv_long} WHEN {S} THEN {lv_short} ELSE {lv} END")
    rec.raw(f"{n}_d", "0", f"CASE WHEN {L} THEN 1 WHEN {S} THEN -1 WHEN {hit_l} OR {hit_s} THEN 0 ELSE r.{n}_d END")
    rec.raw(f"{n}_s", "0", f"CASE WHEN {hit_l} THEN 1 WHEN {hit_s} THEN -1 ELSE 0 END")


def _brk(k: float) -> tuple[str, str]:
    return f"x.pc <= x.r AND x.c > x.r + {k} * x.a", f"x.pc >= x.s AND x.c < x.s - {k} * x.a"


_rec = Recur()
pend(_rec, "br", *_brk(0.10), "x.r", "x.s", "x.l <= LV + 0.15 * x.a AND x.l >= LV - 0.35 * x.a AND x.c > LV AND x.c > x.o",
     "x.h >= LV - 0.15 * x.a AND x.h <= LV + 0.35 * x.a AND x.c < LV AND x.c < x.o", 12)
pend(_rec, "lf", *_brk(0.08), "x.r", "x.s", "x.l <= LV + 0.12 * x.a AND x.c > LV + 0.03 * x.a", "x.h >= LV - 0.12 * x.a AND x.c < LV - 0.03 * x.a", 10)
pend(_rec, "bo", *_brk(0.10), "x.r", "x.s", "x.l <= LV + 0.18 * x.a AND x.c > LV AND x.c > x.o", "x.h >= LV - 0.18 * x.a AND x.c < LV AND x.c < x.o", 12)
pend(_rec, "rr", *_brk(0.08), "x.r", "x.s", "x.l <= LV + 0.10 * x.a AND x.c >= LV + 0.03 * x.a", "x.h >= LV - 0.10 * x.a AND x.c <= LV - 0.03 * x.a", 18)
_sw = ("x.l < x.pl24 - 0.05 * x.a AND x.c > x.pl24", "x.h > x.ph24 + 0.05 * x.a AND x.c < x.ph24")
pend(_rec, "ms", *_sw, "x.h", "x.l", "x.c > LV", "x.c < LV", 3)
pend(_rec, "fv", *_sw, "x.h", "x.l", "x.l > x.h2", "x.h < x.l2", 4)
pend(_rec, "pd", "x.i >= 2 AND x.l < x.dl AND x.c > x.dl", "x.i >= 2 AND x.h > x.dh AND x.c < x.dh", "", "",
     "x.l > x.h2 OR (x.i >= 3 AND x.c > greatest(x.h1, x.h2))", "x.h < x.l2 OR (x.i >= 3 AND x.c < least(x.l1, x.l2))", 8, "true", True)
PENDING_COLUMNS = {"sr_break_retest": "br_s", "sr_level_flip": "lf_s", "sr25_breakout_retest": "bo_s", "sr25_role_reversal_flip": "rr_s",
                   "swp_mss_confirm": "ms_s", "swp_fvg_after": "fv_s", "sr25_pdh_fvg_mss": "pd_s"}
PENDING_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
{PIVOTED},
{_d},
q0 AS (SELECT b.*, dh, dl FROM z b LEFT JOIN days ON days.symbol = b.symbol AND dk = b.t // 86400000),
q AS MATERIALIZED (SELECT *, {ranges((24,))} FROM q0),
{_rec.sql('q', 'rp', 'f')}
{emit_columns(PENDING_COLUMNS, 'f')}"""

# --- zones and gaps ---------------------------------------------------------------------------

_z = Recur()
# First touch of the newest gap.
_new = "CASE WHEN x.l > x.h2 THEN 1 WHEN x.h < x.l2 THEN -1 ELSE 0 END"
_touch = f"({_new}) = 0 AND r.gt_d <> 0 AND x.l <= r.gt_hi AND x.h >= r.gt_lo"
_z.raw("gt_d", "0", f"CASE WHEN ({_new}) <> 0 THEN ({_new}) WHEN {_touch} THEN 0 ELSE r.gt_d END")
_z.raw("gt_lo", "CAST(NULL AS DOUBLE)", "CASE WHEN x.l > x.h2 THEN x.h2 WHEN x.h < x.l2 THEN x.h ELSE r.gt_lo END")
_z.raw("gt_hi", "CAST(NULL AS DOUBLE)", "CASE WHEN x.l > x.h2 THEN x.l WHEN x.h < x.l2 THEN x.l2 ELSE r.gt_hi END")
_z.raw("gt_s", "0", f"CASE WHEN {_touch} AND r.gt_d = 1 AND x.c > r.gt_lo THEN 1 WHEN {_touch} AND r.gt_d = -1 AND x.c < r.gt_hi THEN -1 ELSE 0 END")
# A violated gap changes sides.
_g = f"(CASE WHEN ({_new}) <> 0 THEN ({_new}) ELSE r.gi_d END)"
_fl = f"(CASE WHEN ({_new}) <> 0 THEN 0 ELSE r.gi_f END)"
_lo, _hi = ("(CASE WHEN x.l > x.h2 THEN x.h2 WHEN x.h < x.l2 THEN x.h ELSE r.gi_lo END)", "(CASE WHEN x.l > x.h2 THEN x.l WHEN x.h < x.l2 THEN x.l2 ELSE r.gi_hi END)")
_vio = f"({_fl} = 0 AND (({_g} = 1 AND x.c < {_lo}) OR ({_g} = -1 AND x.c > {_hi})))"
_old = f"({_fl} <> 0 AND x.i > r.gi_e)"
_hit = f"({_fl} <> 0 AND x.i <= r.gi_e AND (({_fl} = 1 AND x.l <= {_hi} AND x.c > {_hi}) OR ({_fl} = -1 AND x.h >= {_lo} AND x.c < {_lo})))"
_z.raw("gi_lo", "CAST(NULL AS DOUBLE)", _lo).raw("gi_hi", "CAST(NULL AS DOUBLE)", _hi)
_z.raw("gi_e", "-1", f"CASE WHEN coalesce({_vio}, false) THEN x.i + 16 ELSE r.gi_e END")
_z.raw("gi_d", "0", f"CASE WHEN coalesce({_old} OR {_hit}, false) THEN 0 ELSE {_g} END")
_z.raw("gi_f", "0", f"CASE WHEN coalesce({_vio}, false) THEN -{_g} WHEN coalesce({_old} OR {_hit}, false) THEN 0 ELSE {_fl} END")
_z.raw("gi_s", "0", f"CASE WHEN {_hit} THEN {_fl} ELSE 0 END")


def zone(n: str, gate: str, arm_l: str, arm_s: str, lo_l: str, hi_l: str, lo_s: str, hi_s: str, bars: int) -> None:
    """A zone armed only when idle, and its retest."""
    A, B = f"({gate}) AND r.{n}_d = 0 AND ({arm_l})", f"({gate}) AND r.{n}_d = 0 AND ({arm_s})"
    old = f"(({gate}) AND r.{n}_d <> 0 AND x.i > r.{n}_e)"
    hit = (f"(({gate}) AND x.i <= r.{n}_e AND ((r.{n}_d = 1 AND x.l <= r.{n}_hi AND x.c > r.{n}_hi) OR (r.{n}_d = -1 AND x.h >= r.{n}_lo AND x.c < r.{n}_lo)))")
    _z.raw(f"{n}_lo", "CAST(NULL AS DOUBLE)", f"CASE WHEN {A} THEN {lo_l} WHEN {B} THEN {lo_s} ELSE r.{n}_lo END")
    _z.raw(f"{n}_hi", "CAST(NULL AS DOUBLE)", f"CASE WHEN {A} THEN {hi_l} WHEN {B} THEN {hi_s} ELSE r.{n}_hi END")
    _z.raw(f"{n}_e", "-1", f"CASE WHEN {A} OR {B} THEN x.i + {bars} ELSE r.{n}_e END")
    _z.raw(f"{n}_d", "0", f"CASE WHEN {A} THEN 1 WHEN {B} THEN -1 WHEN coalesce({old} OR {hit}, false) THEN 0 ELSE r.{n}_d END")
    _z.raw(f"{n}_s", "0", f"CASE WHEN {hit} THEN r.{n}_d ELSE 0 END")


_wide = "greatest(1e-12, x.h - x.l) >= 1.5 * x.a"
zone("im", "x.i >= 20 AND x.a > 0 AND x.v20 > 0", f"{_wide} AND x.v >= 1.3 * x.v20 AND x.c > x.o AND x.pc < x.po",
     f"{_wide} AND x.v >= 1.3 * x.v20 AND x.c < x.o AND x.pc > x.po", "x.l1", "greatest(x.po, x.pc)", "least(x.po, x.pc)", "x.h1", 24)
zone("ba", "x.i >= 16 AND x.a > 0", f"x.ph3 - x.pl3 <= 1.1 * x.a AND {_wide} AND x.c > x.ph3", f"x.ph3 - x.pl3 <= 1.1 * x.a AND {_wide} AND x.c < x.pl3",
     "x.pl3", "x.ph3", "x.pl3", "x.ph3", 30)
ZONE_COLUMNS = {"sr25_fvg_first_touch": "gt_s", "sr25_inverse_fvg": "gi_s", "sr25_impulse_ob_retest": "im_s", "sr25_supply_demand_retest": "ba_s"}
ZONES_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
q AS MATERIALIZED (SELECT *, {ranges((3,))}, CASE WHEN i >= 19 THEN (sum(v) OVER {frame(-19, 0)}) / 20 END AS v20 FROM xa),
{_z.sql('q', 'rz', 'f')}
{emit_columns(ZONE_COLUMNS, 'f')}"""

# --- pivot lists, anchored means ------------------------------------------------------------------

ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
CLUSTER_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
y AS MATERIALIZED (SELECT *, {pivots(2)}, {pivots(3)}, {pivots(4)} FROM xa),
ph AS (SELECT symbol, i AS pi, vh2 AS price, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM y WHERE vh2 IS NOT NULL),
pl AS (SELECT symbol, i AS pi, vl2 AS price, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM y WHERE vl2 IS NOT NULL),
n AS (SELECT *, count(vh2) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS nh, count(vl2) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS nl FROM y WHERE true),
hi AS (SELECT n.symbol, n.i, count(*) AS m, avg(price) AS mean FROM n JOIN ph ON ph.symbol = n.symbol AND ph.k > n.nh - 24 AND ph.k <= n.nh
   WHERE abs(price - h) <= 0.35 * a GROUP BY 1, 2),
lo AS (SELECT n.symbol, n.i, count(*) AS m, avg(price) AS mean FROM n JOIN pl ON pl.symbol = n.symbol AND pl.k > n.nl - 24 AND pl.k <= n.nl
   WHERE abs(price - l) <= 0.35 * a GROUP BY 1, 2),
th AS (SELECT symbol, i, i - 3 AS x3, vh3 AS y3, lag(i - 3) OVER w AS x2, lag(vh3) OVER w AS y2, lag(i - 3, 2) OVER w AS x1, lag(vh3, 2) OVER w AS y1,
   lead(i) OVER w AS nxt FROM y WHERE vh3 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY i)),
tl AS (SELECT symbol, i, i - 3 AS x3, vl3 AS y3, lag(i - 3) OVER w AS x2, lag(vl3) OVER w AS y2, lag(i - 3, 2) OVER w AS x1, lag(vl3, 2) OVER w AS y1,
   lead(i) OVER w AS nxt FROM y WHERE vl3 IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY i)),
seg AS (SELECT *, count(*) FILTER (vh4 IS NOT NULL OR vl4 IS NOT NULL) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS sg,
   last_value(CASE WHEN vl4 IS NOT NULL THEN 1 WHEN vh4 IS NOT NULL THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS sd,
   {prior('max', 'h', 20)} AS ph20, {prior('min', 'l', 20)} AS pl20 FROM y),
seg2 AS (SELECT *, count(*) FILTER (c > ph20 OR c < pl20) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS xg,
   CASE WHEN sg > 0 THEN (sum(tp * v) OVER (PARTITION BY symbol, sg ORDER BY i {ALL})) / (sum(v) OVER (PARTITION BY symbol, sg ORDER BY i {ALL})) END AS sv FROM seg),
vw AS (SELECT *, CASE WHEN xg > 0 THEN (sum(tp * v) OVER (PARTITION BY symbol, xg ORDER BY i {ALL})) / (sum(v) OVER (PARTITION BY symbol, xg ORDER BY i {ALL})) END AS xv,
   CASE WHEN vh4 IS NULL AND vl4 IS NULL THEN lag(sv) OVER (PARTITION BY symbol ORDER BY i) END AS psv FROM seg2),
f AS (SELECT b.*, hi.m AS hm, hi.mean AS hmean, lo.m AS lm, lo.mean AS lmean,
   th.y1 AS hy1, (th.y2 - th.y1) / (th.x2 - th.x1) AS hs, th.x1 AS hx1, th.x3 AS hx3, th.y3 AS hy3,
   tl.y1 AS ly1, (tl.y2 - tl.y1) / (tl.x2 - tl.x1) AS ls, tl.x1 AS lx1, tl.x3 AS lx3, tl.y3 AS ly3
   FROM vw b LEFT JOIN hi ON hi.symbol = b.symbol AND hi.i = b.i LEFT JOIN lo ON lo.symbol = b.symbol AND lo.i = b.i
   LEFT JOIN th ON th.symbol = b.symbol AND b.i >= th.i AND (th.nxt IS NULL OR b.i < th.nxt)
   LEFT JOIN tl ON tl.symbol = b.symbol AND b.i >= tl.i AND (tl.nxt IS NULL OR b.i < tl.nxt))
{emit({
    'sr25_fractal_cluster_rejection': ("a > 0 AND lm >= 2 AND c > o AND c > lmean", "a > 0 AND hm >= 2 AND c < o AND c < hmean"),
    'sr25_trendline_breakout': (
        "a > 0 AND abs(hy3 - (hy1 + hs * (hx3 - hx1))) <= 0.35 * a AND pc <= hy1 + hs * ((i - 1) - hx1) AND c > hy1 + hs * (i - hx1) + 0.08 * a",
        "a > 0 AND abs(ly3 - (ly1 + ls * (lx3 - lx1))) <= 0.35 * a AND pc >= ly1 + ls * ((i - 1) - lx1) AND c < ly1 + ls * (i - lx1) - 0.08 * a"),
    'sr25_swing_anchored_vwap': (
        "(a > 0 AND sd = 1 AND l <= sv + 0.15 * a AND c > sv AND c > o) OR (NOT coalesce(a > 0 AND sd = -1 AND h >= sv - 0.15 * a AND c < sv AND c < o, false) "
        "AND a > 0 AND pc <= psv AND c > sv + 0.08 * a)",
        "(a > 0 AND sd = -1 AND h >= sv - 0.15 * a AND c < sv AND c < o) OR (a > 0 AND pc >= psv AND c < sv - 0.08 * a)"),
    'vis_structure_vwap': ("pc <= xv AND c > xv + 0.05 * a", "pc >= xv AND c < xv - 0.05 * a"),
}, 'f')}"""

# --- trailing stops -----------------------------------------------------------------------------

_t = Recur().rma("a10", 10, "tr").ema("e10", 10, "c")


def bands(n: str, mean: str, width: str, on: str, first: str, seed_on: bool) -> None:
    """Two trailing bands and the side in force; ``on`` once defined, ``first`` on the first defined bar."""
    lo, hi = f"({mean} - {width})", f"({mean} + {width})"
    nul = "CAST(NULL AS DOUBLE)"
    s_lo, s_hi = (lo, hi) if seed_on else (nul, nul)
    _t.raw(f"{n}_lo", s_lo, f"CASE WHEN NOT ({on}) THEN {nul} WHEN ({first}) THEN {lo} WHEN {mean} > r.{n}_lo THEN greatest({lo}, r.{n}_lo) ELSE {lo} END")
    _t.raw(f"{n}_hi", s_hi, f"CASE WHEN NOT ({on}) THEN {nul} WHEN ({first}) THEN {hi} WHEN {mean} < r.{n}_hi THEN least({hi}, r.{n}_hi) ELSE {hi} END")
    _t.raw(f"{n}_d", "1", f"CASE WHEN NOT ({on}) OR ({first}) THEN r.{n}_d WHEN r.{n}_d = -1 AND {mean} > r.{n}_hi THEN 1 WHEN r.{n}_d = 1 AND {mean} < r.{n}_lo THEN -1 ELSE r.{n}_d END")


_a10 = "(CASE WHEN x.i = 9 THEN (r.a10 + x.tr) / 10 ELSE (r.a10 * 9 + x.tr) / 10 END)"
_e10 = f"({num(2 / 11)} * x.c + {num(1 - 2 / 11)} * r.e10)"
bands("pm", _e10, f"3 * {_a10}", "x.i >= 9", "x.i = 9", False)
# ATR trailing stop.
_st = "coalesce(r.ut, 0)"
_t.raw("ut", "CAST(NULL AS DOUBLE)",
       f"CASE WHEN x.i < 9 THEN NULL WHEN x.c > {_st} AND x.pc > {_st} THEN greatest({_st}, x.c - {_a10}) "
       f"WHEN x.c < {_st} AND x.pc < {_st} THEN least({_st}, x.c + {_a10}) WHEN x.c > {_st} THEN x.c - {_a10} ELSE x.c + {_a10} END")
# Super trend.
_up, _dn = f"((x.h + x.l) / 2 + 3 * {_a10})", f"((x.h + x.l) / 2 - 3 * {_a10})"
_t.raw("st_u", "CAST(NULL AS DOUBLE)", f"CASE WHEN x.i < 9 THEN NULL WHEN x.i = 9 OR {_up} < r.st_u OR x.pc > r.st_u THEN {_up} ELSE r.st_u END")
_t.raw("st_l", "CAST(NULL AS DOUBLE)", f"CASE WHEN x.i < 9 THEN NULL WHEN x.i = 9 OR {_dn} > r.st_l OR x.pc < r.st_l THEN {_dn} ELSE r.st_l END")
_t.raw("st_d", "1", "CASE WHEN x.i <= 9 THEN r.st_d WHEN r.st_d = -1 AND x.c > r.st_u THEN 1 WHEN r.st_d = 1 AND x.c < r.st_l THEN -1 ELSE r.st_d END")
# Adaptive means and their lines.
for _n, _p, _pct in (("o1", 2, 1.4), ("o2", 40, 1.0)):
    _k = f"({num(2 / (_p + 1))} * x.cmo)"
    _ma = f"({_k} * x.c + (1 - {_k}) * r.{_n}_m)"
    _t.raw(f"{_n}_m", "x.c", _ma)
    bands(_n, _ma, f"({_ma} * {num(_pct)} * 0.01)", "true", "false", False)
    # The first bar is defined, so its bands come from the close itself.
    _t.seed[-3] = f"x.c - x.c * {num(_pct)} * 0.01 AS {_n}_lo"
    _t.seed[-2] = f"x.c + x.c * {num(_pct)} * 0.01 AS {_n}_hi"
# Money-flow trend.
_t.raw("atr_line", "CAST(NULL AS DOUBLE)",
       "CASE WHEN x.s14 IS NULL OR x.mf IS NULL THEN NULL WHEN x.mf >= 50 THEN greatest(x.l - x.s14, coalesce(r.atr_line, 0)) ELSE least(x.h + x.s14, coalesce(r.atr_line, 0)) END")


def line(n: str, pct: float) -> str:
    stop = f"(CASE WHEN {n}_d = 1 THEN {n}_lo ELSE {n}_hi END)"
    return f"CASE WHEN {n}_m > {stop} THEN {stop} * (200 + {num(pct)}) / 200 ELSE {stop} * (200 - {num(pct)}) / 200 END"


TRAILING_RULES = {
    "pmax": ("pe <= ppm AND e10 > pm", "pe >= ppm AND e10 < pm"),
    "ut_bot_quantnomad": ("pc <= put AND c > ut", "pc >= put AND c < ut"),
    "vis_supertrend_10_3": ("st_d <> pst AND st_d = 1", "st_d <> pst AND st_d = -1"),
    "ott": ("i >= 4 AND pm1 <= l13 AND o1_m > l12", "i >= 4 AND pm1 >= l13 AND o1_m < l12"),
    "tott": ("i >= 4 AND pm2 <= l23 * 1.006 AND o2_m > l22 * 1.006", "i >= 4 AND pm2 >= l23 * 0.994 AND o2_m < l22 * 0.994"),
    "alphatrend": ("at1 <= at3 AND atr_line > at2", "at1 >= at3 AND atr_line < at2"),
}
TRAILING_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
fl AS MATERIALIZED (SELECT *, CASE WHEN tp > lag(tp) OVER w THEN tp * v ELSE 0.0 END AS fu, CASE WHEN tp < lag(tp) OVER w THEN tp * v ELSE 0.0 END AS fd,
  CASE WHEN i >= 13 THEN (sum(tr) OVER {frame(-13, 0)}) / 14 END AS s14, sum(up) OVER {frame(-8, 0)} AS u9, sum(dn) OVER {frame(-8, 0)} AS d9
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY i)),
q AS MATERIALIZED (SELECT *, CASE WHEN u9 + d9 = 0 THEN 0.0 ELSE abs((u9 - d9) / (u9 + d9)) END AS cmo,
  CASE WHEN nd = 0 THEN 100.0 ELSE 100 - 100 / (1 + nu / nd) END AS mf FROM (SELECT *, {lag_chain('fu', [1] * 14)} AS nu, {lag_chain('fd', [1] * 14)} AS nd
  FROM fl WINDOW w AS (PARTITION BY symbol ORDER BY i))),
{_t.sql('q', 'rt', 'g')},
g2 AS (SELECT *, CASE WHEN pm_d = 1 THEN pm_lo ELSE pm_hi END AS pm, {line('o1', 1.4)} AS ln1, {line('o2', 1.0)} AS ln2 FROM g),
f AS (SELECT *, lag(e10) OVER w AS pe, lag(pm) OVER w AS ppm, lag(ut) OVER w AS put, lag(st_d) OVER w AS pst, lag(o1_m) OVER w AS pm1, lag(o2_m) OVER w AS pm2,
  lag(ln1, 2) OVER w AS l12, lag(ln1, 3) OVER w AS l13, lag(ln2, 2) OVER w AS l22, lag(ln2, 3) OVER w AS l23,
  lag(atr_line) OVER w AS at1, lag(atr_line, 2) OVER w AS at2, lag(atr_line, 3) OVER w AS at3 FROM g2 WINDOW w AS (PARTITION BY symbol ORDER BY i))
{emit(TRAILING_RULES, 'f')}"""

# --- chart indicators --------------------------------------------------------------------------------


def wma(src: str, p: int) -> str:
    return f"({lag_chain(src, range(1, p + 1))}) / {p * (p + 1) // 2}"


WIN = "WINDOW w AS (PARTITION BY symbol ORDER BY i)"


def layers(src: str, *steps: tuple[str, str]) -> str:
    """Named layers, each adding columns to the one before."""
    out, last = [], src
    for name, cols in steps:
        out.append(f"{name} AS MATERIALIZED (SELECT *, {cols} FROM {last} {WIN})")
        last = name
    return ",\n".join(out)


def mean(src: str, p: int) -> str:
    return f"CASE WHEN i >= {p - 1} THEN (sum({src}) OVER {frame(-p + 1, 0)}) / {p} END"


def sd(src: str, p: int) -> str:
    m = f"((sum({src}) OVER {frame(-p + 1, 0)}) / {p})"
    return f"CASE WHEN i >= {p - 1} THEN sqrt(greatest(0.0, (sum({src} * {src}) OVER {frame(-p + 1, 0)}) / {p} - {m} * {m})) END"


def sd_ordered(src: str, p: int) -> str:
    s, q = f"({lag_chain(src, [1] * p)})", f"({lag_chain(f'{src}_sq', [1] * p)})"
    return f"CASE WHEN {q} IS NOT NULL THEN sqrt(greatest(0.0, {q} / {p} - ({s} / {p}) * ({s} / {p}))) END"


def turning(x: str) -> tuple[str, str]:
    a, b = f"lag({x}) OVER {W}", f"lag({x}, 2) OVER {W}"
    return f"{x} > {a} AND {a} <= {b}", f"{x} < {a} AND {a} >= {b}"


def cross(a: str, b: str) -> tuple[str, str]:
    p, q = f"lag({a}) OVER {W}", f"lag({b}) OVER {W}"
    return f"{p} <= {q} AND {a} > {b}", f"{p} >= {q} AND {a} < {b}"


def both(pair: tuple[str, str], up: str, dn: str) -> tuple[str, str]:
    return f"{pair[0]} AND {up}", f"{pair[1]} AND {dn}"


def reenter(lo: str, hi: str) -> tuple[str, str]:
    return f"pc < {lo} AND c >= {lo}", f"pc > {hi} AND c <= {hi}"


_krn = [math.exp(-(k * k) / (2 * (30 / 3) * (30 / 3))) for k in range(30)]
KERNEL = "(" + " + ".join(f"{num(w)} * " + ("c" if k == 0 else f"lag(c, {k}) OVER w") for k, w in enumerate(_krn)) + f") / {num(sum(_krn))}"
SHAPE_RULES = {
    "mavilimw": (f"lag(mv) OVER {W} - lag(mv, 2) OVER {W} <= 0 AND mv - lag(mv) OVER {W} > 0", f"lag(mv) OVER {W} - lag(mv, 2) OVER {W} >= 0 AND mv - lag(mv) OVER {W} < 0"),
    "ssl_hybrid_flip": cross("c", "ssl"), "vis_hull_suite": turning("hc"), "vis_golden_cross_50_200": cross("m50", "m200"),
    "vis_fractal_breakout": ("pc <= ph5 AND c > ph5", "pc >= pl5 AND c < pl5"), "vis_coppock": turning("cop"),
    "vis_bb_mean_reversion": reenter("(m20 - 2 * d20)", "(m20 + 2 * d20)"),
    "vis_fibonacci_bb": ("pc <= m20 + 1.618 * d20 AND c > m20 + 1.618 * d20", "pc >= m20 - 1.618 * d20 AND c < m20 - 1.618 * d20"),
    "vis_vixfix_reversal": (f"lag(wvf) OVER {W} > wm + 2 * wd AND wvf <= wm + 2 * wd", "wvf > wm + 2 * wd AND c < o"),
    "vis_sr_breaks": ("c > ph50", "c < pl50"), "vis_high_volume_box": ("v >= 1.8 * v20 AND c > ph20", "v >= 1.8 * v20 AND c < pl20"),
    "vis_ichimoku_hull": (f"(ph9 + pl9) / 2 > (ph26 + pl26) / 2 AND c > hc AND hc > lag(hc) OVER {W}", f"(ph9 + pl9) / 2 < (ph26 + pl26) / 2 AND c < hc AND hc < lag(hc) OVER {W}"),
    "vis_candlestick_reversal": ("c > o AND pc < po AND o <= pc AND c >= po", "c < o AND pc > po AND o >= pc AND c <= po"),
    "vis_tma_overlay": reenter("(tma - 1.5 * d20)", "(tma + 1.5 * d20)"), "vis_nadaraya_watson": reenter("(k30 - 2 * nd)", "(k30 + 2 * nd)"),
    "vis_volume_delta_pivot": ("i >= 1 AND vd > 2 * abs(vdm) AND c > o", "i >= 1 AND vd < -2 * abs(vdm) AND c < o"),
}
SHAPES_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{layers('x',
        ('s1', f"{wma('c', 3)} AS w3, {wma('h', 30)} AS h30, {wma('h', 60)} AS h60, {wma('l', 30)} AS l30, {wma('l', 60)} AS l60, {wma('c', 27)} AS c27, {wma('c', 55)} AS c55, "
               f"{mean('c', 50)} AS m50, {mean('c', 200)} AS m200, {mean('c', 20)} AS m20, {sd('c', 20)} AS d20, {mean('v', 20)} AS v20, {mean('c', 10)} AS m10, "
               f"100 * (c / lag(c, 14) OVER w - 1) + 100 * (c / lag(c, 11) OVER w - 1) AS rocs, {KERNEL} AS k30, {prior('max', 'c', 22)} AS pc22, "
               f"(CASE WHEN c >= o THEN 1.0 ELSE -1.0 END) * v AS vd, {ranges((5, 9, 20, 26, 50))}"),
        ('s2', f"{wma('w3', 5)} AS w5, 2 * h30 - h60 AS hd, 2 * l30 - l60 AS ld, 2 * c27 - c55 AS cd, {wma('rocs', 10)} AS cop, c - k30 AS res, (c - k30) * (c - k30) AS res_sq, "
               f"CASE WHEN pc22 > 0 THEN 100 * (pc22 - l) / pc22 END AS wvf, {mean('vd', 20)} AS vdm, ({lag_chain('m10', [1] * 10)}) / 10 AS tma"),
        ('s3', f"{wma('w5', 8)} AS w8, {wma('hd', 8)} AS hh, {wma('ld', 8)} AS hl, {wma('cd', 7)} AS hc, {sd_ordered('res', 30)} AS nd, wvf * wvf AS wvf_sq"),
        ('s4', f"{wma('w8', 13)} AS w13, ({lag_chain('wvf', [1] * 20)}) / 20 AS wm, {sd_ordered('wvf', 20)} AS wd, "
               f"last_value(CASE WHEN c > hh THEN 1 WHEN c < hl THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS sst"),
        ('s5', f"{wma('w13', 21)} AS w21, CASE WHEN sst = -1 THEN hh ELSE hl END AS ssl"), ('s6', f"{wma('w21', 34)} AS mv"))}
{emit(SHAPE_RULES, 's6')}"""

_o = (Recur().rma("a7", 7, "tr").rma("a14", 14, "tr").rma("a20", 20, "tr").rma("g14", 14, "up").rma("s14", 14, "dn").rma("g7", 7, "up").rma("s7", 7, "dn")
      .ema("e5c", 5, "c").ema("e5o", 5, "o").ema("e8", 8, "c").ema("e9", 9, "c").ema("e20", 20, "c").ema("e21", 21, "c").ema("e50", 50, "c").ema("e12", 12, "c").ema("e26", 26, "c")
      .rma("atx", 14, "tr").rma("pd", 14, "dmu").rma("md", 14, "dmd"))
_macd = f"({num(2 / 13)} * x.c + {num(1 - 2 / 13)} * r.e12 - ({num(2 / 27)} * x.c + {num(1 - 2 / 27)} * r.e26))"
_o.raw("sg", "CAST(0 AS DOUBLE)", f"{num(0.2)} * {_macd} + {num(0.8)} * r.sg")
_dx = Recur().raw("adx", "CAST(0 AS DOUBLE)",
                  "CASE WHEN x.i < 13 THEN 0.0 WHEN x.i < 26 THEN r.adx + x.dx WHEN x.i = 26 THEN (r.adx + x.dx) / 14 ELSE (r.adx * 13 + x.dx) / 14 END", "CASE WHEN i >= 26 THEN adx END")
R14, R7 = RSI, RSI.replace("14", "7")
OSC_RULES = {
    "vis_bollinger_rsi_double": ("c < m20 - 2 * d20 AND r14 < 30", "c > m20 + 2 * d20 AND r14 > 70"),
    "vis_macd_sma200": both(cross("mc", "sg"), "c > m200", "c < m200"), "vis_macd_rsi": both(cross("mc", "sg"), "r14 > 50", "r14 < 50"),
    "vis_macd_stoch": both(cross("mc", "sg"), "sk < 35", "sk > 65"), "vis_ema_cross_9_21": cross("e9", "e21"),
    "vis_ema_slope_cross": both(cross("e20", "e50"), f"i >= 2 AND e50 > lag(e50) OVER {W}", f"i >= 2 AND e50 < lag(e50) OVER {W}"),
    "vis_squeeze_momentum": (f"2 * d20 >= 1.5 * a20 AND mo > 0 AND lag(mo) OVER {W} <= 0", f"2 * d20 >= 1.5 * a20 AND mo < 0 AND lag(mo) OVER {W} >= 0"),
    "vis_adx_di": both(cross("pdi", "mdi"), "adx >= 20", "adx >= 20"),
    "vis_rsi_entries": (f"lag(r14) OVER {W} <= 30 AND r14 > 30", f"lag(r14) OVER {W} >= 70 AND r14 < 70"),
    "vis_auto_range_breakout": ("ph30 - pl30 <= 6 * a14 AND c > ph30", "ph30 - pl30 <= 6 * a14 AND c < pl30"),
    "vis_open_close_cross": cross("e5c", "e5o"), "vis_super_scalper": both(cross("e8", "e21"), "r7 > 55 AND h - l > 0.5 * a7", "r7 < 45 AND h - l > 0.5 * a7"),
}
DM = f"""d AS MATERIALIZED (SELECT *, CASE WHEN i = 0 THEN 0.0 WHEN h - h1 > l1 - l AND h - h1 > 0 THEN h - h1 ELSE 0.0 END AS dmu,
  CASE WHEN i = 0 THEN 0.0 WHEN l1 - l > h - h1 AND l1 - l > 0 THEN l1 - l ELSE 0.0 END AS dmd FROM x)"""
OSC_TABLES = f"""WITH RECURSIVE {walk()},
{LAGS},
{DM},
{_o.sql('d', 'ro', 'p')},
{layers('p',
        ('p1', f"{mean('c', 20)} AS m20, {sd('c', 20)} AS d20, {mean('c', 200)} AS m200, c - lag(c, 12) OVER w AS mo, e12 - e26 AS mc, CASE WHEN g14 IS NOT NULL THEN {R14} END AS r14, "
               f"CASE WHEN g7 IS NOT NULL THEN {R7} END AS r7, CASE WHEN atx > 0 THEN 100 * pd / atx END AS pdi, CASE WHEN atx > 0 THEN 100 * md / atx END AS mdi, {ranges((30,))}, "
               f"CASE WHEN i >= 13 THEN CASE WHEN max(h) OVER {frame(-13, 0)} = min(l) OVER {frame(-13, 0)} THEN 50 ELSE 100 * (c - min(l) OVER {frame(-13, 0)}) / (max(h) OVER {frame(-13, 0)} - min(l) OVER {frame(-13, 0)}) END END AS sk"),
        ('p2', "CASE WHEN pdi + mdi = 0 THEN 0.0 WHEN pdi IS NULL THEN NULL ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx"))},
{_dx.sql('p2', 'rd', 'p3')}"""
OSC_SQL = f"{OSC_TABLES}\n{emit(OSC_RULES, 'p3')}"

# --- smoothed RSI bands, exits with a flat bar, order blocks ---------------------------------------------

_q = Recur().rma("g", 6, "up").rma("s", 6, "dn")
_g6 = "(CASE WHEN x.i = 5 THEN (r.g + x.up) / 6 ELSE (r.g * 5 + x.up) / 6 END)"
_s6 = "(CASE WHEN x.i = 5 THEN (r.s + x.dn) / 6 ELSE (r.s * 5 + x.dn) / 6 END)"
_q.raw("rs", "CAST(NULL AS DOUBLE)", f"CASE WHEN x.i < 5 THEN NULL WHEN {_s6} = 0 THEN 100.0 WHEN {_g6} = 0 THEN 0.0 ELSE 100 - 100 / (1 + {_g6} / {_s6}) END")


def chained(name: str, p: int, src: str) -> Recur:
    """Exponential mean whose input may start undefined."""
    a = 2 / (p + 1)
    return Recur().raw(name, f"x.{src}", f"CASE WHEN r.{name} IS NULL THEN x.{src} ELSE {num(a)} * x.{src} + {num(1 - a)} * r.{name} END")


def qqe_bands(n: str, factor: float) -> Recur:
    """Trailing bands of the smoothed RSI ``rm`` with width ``e2`` times the factor, two bars of memory, and the side."""
    d = f"(x.e2 * {num(factor)})"
    l1, s1 = f"r.{n}_l", f"r.{n}_s"
    on = "x.e2 IS NOT NULL"
    cross = "((({a0} <= {b0} AND {a1} > {b1}) OR ({a0} >= {b0} AND {a1} < {b1})))"
    up = cross.format(a0="x.prm", b0=f"r.{n}_s2", a1="x.rm", b1=s1)
    dn = cross.format(a0=f"r.{n}_l2", b0="x.prm", a1=l1, b1="x.rm")
    nul = "CAST(NULL AS DOUBLE)"
    return (Recur()
            .raw(f"{n}_l", nul, f"CASE WHEN {on} THEN CASE WHEN x.prm > coalesce({l1}, 0) AND x.rm > coalesce({l1}, 0) THEN greatest(coalesce({l1}, 0), x.rm - {d}) ELSE x.rm - {d} END END")
            .raw(f"{n}_s", nul, f"CASE WHEN {on} THEN CASE WHEN x.prm < coalesce({s1}, 0) AND x.rm < coalesce({s1}, 0) THEN least(coalesce({s1}, 0), x.rm + {d}) ELSE x.rm + {d} END END")
            .raw(f"{n}_l2", nul, l1).raw(f"{n}_s2", nul, s1)
            .raw(f"{n}_t", "1", f"CASE WHEN {on} AND {s1} IS NOT NULL AND r.{n}_s2 IS NOT NULL THEN CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE r.{n}_t END ELSE r.{n}_t END"))


def fast(n: str) -> str:
    return f"CASE WHEN {n}_t = 1 THEN {n}_l ELSE {n}_s END"


QQE_TABLES = f"""{_q.sql('x', 'q1', 'y1')},
{chained('rm', 5, 'rs').sql('y1', 'q2', 'y2')},
y3 AS MATERIALIZED (SELECT *, lag(rm) OVER {W} AS prm, abs(lag(rm) OVER {W} - rm) AS mv FROM y2),
{chained('e1', 11, 'mv').sql('y3', 'q3', 'y4')},
{chained('e2', 11, 'e1').sql('y4', 'q4', 'y5')},
{qqe_bands('ka', 3.0).sql('y5', 'q5', 'y6')},
{qqe_bands('kb', 1.61).sql('y6', 'q6', 'y7')}"""
QQE_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{QQE_TABLES}
SELECT symbol, timeframe, t, round(rm, 6) + 0.0 AS ma, round({fast('ka')}, 6) + 0.0 AS fast FROM y7"""

_ce = Recur()
_lo, _hi = "(x.ha - 2 * x.ptr)", "(x.ha + 2 * x.ptr)"
_ce.raw("cl", "CAST(NULL AS DOUBLE)", f"CASE WHEN r.cl IS NULL THEN {_lo} WHEN x.ha > r.cl THEN greatest({_lo}, r.cl) ELSE {_lo} END")
_ce.raw("cs", "CAST(NULL AS DOUBLE)", f"CASE WHEN r.cs IS NULL THEN {_hi} WHEN x.ha < r.cs THEN least({_hi}, r.cs) ELSE {_hi} END")
_ce.raw("cd", "1", "CASE WHEN r.cs IS NOT NULL AND x.ha > r.cs THEN 1 WHEN r.cl IS NOT NULL AND x.ha < r.cl THEN -1 ELSE r.cd END")
_tg = Recur()
_enter = "(CASE WHEN x.cd = 1 AND x.pcd = -1 AND x.cu THEN 1 WHEN x.cd = -1 AND x.pcd = 1 AND x.cn THEN -1 ELSE 0 END)"
_out = "((r.pos = 1 AND x.cn) OR (r.pos = -1 AND x.cu))"
_tg.raw("pos", "0", f"CASE WHEN r.pos = 0 AND r.que <> 0 THEN r.que WHEN r.pos = 0 THEN {_enter} WHEN {_out} THEN 0 ELSE r.pos END")
_tg.raw("que", "0", f"CASE WHEN r.pos = 0 THEN 0 WHEN {_out} AND {_enter} = -r.pos THEN {_enter} ELSE 0 END")


def _line(src: str, p: int) -> str:
    sx, sxx = (p - 1) * p / 2, (p - 1) * p * (2 * p - 1) / 6
    sy, sxy = f"({lag_chain(src, [1] * p)})", f"({lag_chain(src, range(p))})"
    slope = f"(({p} * {sxy} - {num(sx)} * {sy}) / {num(p * sxx - sx * sx)})"
    return f"({sy} - {slope} * {num(sx)}) / {p} + {slope} * {p - 1}"


MOMENTUM_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{QQE_TABLES},
{layers('y7',
        ('m1', f"{wma('h', 30)} AS h30, {wma('h', 60)} AS h60, {wma('l', 30)} AS l30, {wma('l', 60)} AS l60, {fast('ka')} - 50 AS fo, {fast('kb')} AS fb, "
               "lag((o + h + l + c) / 4) OVER w AS ha, lag(tr) OVER w AS ptr"),
        ('m2', f"2 * h30 - h60 AS hd, 2 * l30 - l60 AS ld, CASE WHEN count(fo) OVER {frame(-49, 0)} = 50 THEN list(fo) OVER {frame(-49, 0)} END AS fl, {_line('ha', 50)} AS lr1"),
        ('m3', f"{wma('hd', 8)} AS hh, {wma('ld', 8)} AS hl, list_reduce(list_prepend(0.0, fl), lambda a, z: a + z) / 50 AS fm, 2 * lr1 - ({_line('lr1', 50)}) AS zl"),
        ('m4', f"last_value(CASE WHEN c > hh THEN 1 WHEN c < hl THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS sst, "
               "sqrt(list_reduce(list_prepend(0.0, [(z - fm) * (z - fm) FOR z IN fl]), lambda a, z: a + z) / 50) AS fs, "
               "coalesce(lag(ha) OVER w <= lag(zl) OVER w AND ha > zl, false) AS cu, coalesce(lag(ha) OVER w >= lag(zl) OVER w AND ha < zl, false) AS cn"),
        ('m5', "CASE WHEN sst = -1 THEN hh ELSE hl END AS ssl"),
        ('m6', f"count(*) FILTER ((lag_c <= lag_s AND c > ssl) OR (lag_c >= lag_s AND c < ssl)) OVER (PARTITION BY symbol ORDER BY i {ALL}) AS sx")).replace("FROM m5 WINDOW", "FROM (SELECT *, lag(c) OVER " + W + " AS lag_c, lag(ssl) OVER " + W + " AS lag_s FROM m5) WINDOW")},
{_ce.sql('m6', 'c1', 'm7')},
m8 AS MATERIALIZED (SELECT *, lag(cd) OVER {W} AS pcd FROM m7),
{_tg.sql('m8', 'c2', 'm9')},
f AS (SELECT *, lag(pos) OVER {W} AS ppos FROM m9)
SELECT * FROM ({emit({'ssl_hybrid_qqe_flip': ("sx > 0 AND c > ssl AND rm - 50 > 3 AND rm - 50 > fm + 0.35 * fs AND fb - 50 > 0", "sx > 0 AND c < ssl AND rm - 50 < -3 AND rm - 50 < fm - 0.35 * fs AND fb - 50 < 0")}, 'f')})
UNION ALL SELECT symbol, timeframe, 'chandelier_zlsma', t, CAST(pos AS BIGINT) FROM f WHERE pos <> 0 OR coalesce(ppos, 0) <> 0"""

_ob = Recur()
_ok = "(x.ph24 IS NOT NULL AND x.a > 0)"
_swl, _sws = "(x.l < x.pl24 - 0.05 * x.a AND x.c > x.pl24)", "(x.h > x.ph24 + 0.05 * x.a AND x.c < x.ph24)"
_age = "(x.i - r.at0)"
_idle = f"({_ok} AND r.sw <> 0 AND r.zd = 0)"
_disp = f"({_idle} AND {_age} <= 4 AND greatest(1e-12, x.h - x.l) >= 1.2 * x.a AND (x.c - x.o) * r.sw > 0)"
# The last bar of the other colour, at most four bars before the sweep.
_k = "(CASE WHEN r.sw = 1 THEN least(coalesce(x.kd, 99), x.i - r.at0 + 4) ELSE least(coalesce(x.ku, 99), x.i - r.at0 + 4) END)"
_bo, _bh, _bl, _bc = (f"x.back_{z}[{_k}]" for z in "ohlc")
_zd, _zlo, _zhi = (f"(CASE WHEN {_disp} THEN r.sw ELSE r.zd END)", f"(CASE WHEN {_disp} THEN CASE WHEN r.sw = 1 THEN {_bl} ELSE least({_bo}, {_bc}) END ELSE r.zlo END)",
                   f"(CASE WHEN {_disp} THEN CASE WHEN r.sw = 1 THEN greatest({_bo}, {_bc}) ELSE {_bh} END ELSE r.zhi END)")
_gone = f"({_idle} AND {_age} > 4)"
_late = f"({_ok} AND r.zd <> 0 AND x.i > r.zu)"
_obhit = f"({_ok} AND r.sw <> 0 AND NOT {_gone} AND NOT {_late} AND (({_zd} = 1 AND x.l <= {_zhi} AND x.c > {_zhi}) OR ({_zd} = -1 AND x.h >= {_zlo} AND x.c < {_zlo})))"
_end = f"coalesce({_gone} OR {_late} OR {_obhit}, false)"
_ob.raw("sw", "0", f"CASE WHEN {_ok} AND r.sw = 0 AND {_swl} THEN 1 WHEN {_ok} AND r.sw = 0 AND {_sws} THEN -1 WHEN {_end} THEN 0 ELSE r.sw END")
_ob.raw("at0", "-1", f"CASE WHEN {_ok} AND r.sw = 0 AND ({_swl} OR {_sws}) THEN x.i ELSE r.at0 END")
_ob.raw("zd", "0", f"CASE WHEN {_end} THEN 0 ELSE {_zd} END").raw("zlo", "CAST(NULL AS DOUBLE)", _zlo).raw("zhi", "CAST(NULL AS DOUBLE)", _zhi)
_ob.raw("zu", "-1", f"CASE WHEN {_disp} THEN x.i + 20 ELSE r.zu END")
_ob.raw("ob_s", "0", f"CASE WHEN {_obhit} THEN {_zd} ELSE 0 END")
# Scored zones: a list of (side, price, born), newest last.
_new = ("list_concat(r.zs, list_filter([{'d': -1, 'p': x.vh2, 'b': x.i}, {'d': 1, 'p': x.vl2, 'b': x.i}], "
        "lambda z: z.p IS NOT NULL AND (CASE WHEN x.v20 > 0 THEN x.v2 / x.v20 ELSE 1 END) + (CASE WHEN x.a > 0 THEN abs(x.c - x.c2) / x.a ELSE 0 END) >= 1.8))")
_zs = f"({_new})[-40:]"
_hits = (f"list_filter({_zs}, lambda z: x.a > 0 AND x.i - z.b >= 2 AND ((z.d = 1 AND abs(x.l - z.p) <= 0.25 * x.a AND x.c > z.p) OR (z.d = -1 AND abs(x.h - z.p) <= 0.25 * x.a AND x.c < z.p)))")
_ob.raw("zs", "CAST([] AS STRUCT(d INTEGER, p DOUBLE, b BIGINT)[])", f"CASE WHEN len({_hits}) > 0 THEN list_filter({_zs}, lambda z: z <> ({_hits})[-1]) ELSE {_zs} END")
_ob.raw("zs_s", "0", f"CASE WHEN len({_hits}) > 0 THEN ({_hits})[-1].d ELSE 0 END")
BLOCKS_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
q0 AS MATERIALIZED (SELECT *, {ranges((24,))}, {pivots(2)}, CASE WHEN i >= 19 THEN (sum(v) OVER {frame(-19, 0)}) / 20 END AS v20, lag(v, 2) OVER {W} AS v2, lag(c, 2) OVER {W} AS c2,
  {', '.join(f"list_reverse(list({z}) OVER {frame(-9, -1)}) AS back_{z}" for z in "ohlc")}, list_reverse(list(c - o) OVER {frame(-9, -1)}) AS back_d FROM xa),
q AS MATERIALIZED (SELECT *, list_position([z < 0 FOR z IN back_d], true) AS kd, list_position([z > 0 FOR z IN back_d], true) AS ku FROM q0),
{_ob.sql('q', 'ro', 'f')}
{emit_columns({'sr25_lsob': 'ob_s', 'sr25_kernel_supply_demand': 'zs_s'}, 'f')}"""

# --- swing patterns ---------------------------------------------------------------------------------------

_sw = Recur()
_last = "r.sw[-1]"
_ev = (f"(CASE WHEN x.vh3 IS NOT NULL AND (x.vl3 IS NULL OR len(r.sw) = 0 OR {_last}.k <> 'H') THEN {{'k': 'H', 'p': x.vh3, 'j': x.i - 3}} "
       f"WHEN x.vl3 IS NOT NULL THEN {{'k': 'L', 'p': x.vl3, 'j': x.i - 3}} END)")
_sw.raw("sw", "CAST([] AS STRUCT(k VARCHAR, p DOUBLE, j BIGINT)[])",
        f"CASE WHEN {_ev} IS NULL THEN r.sw WHEN len(r.sw) = 0 THEN [{_ev}] WHEN {_ev}.k <> {_last}.k THEN CASE WHEN {_ev}.j > {_last}.j THEN list_append(r.sw, {_ev})[-8:] ELSE r.sw END "
        f"WHEN ({_ev}.k = 'H' AND {_ev}.p > {_last}.p) OR ({_ev}.k = 'L' AND {_ev}.p < {_last}.p) THEN list_append(r.sw[:-2], {_ev}) ELSE r.sw END")
_P = [f"sw[-{n}].p" for n in range(1, 6)]


def _ret(ratio: float, far: float | None = None) -> str:
    up, dn = f"(p1 - {ratio} * (p1 - p2))", f"(p1 + {ratio} * (p2 - p1))"
    in_up = "true" if far is None else f"h >= p1 - {far} * (p1 - p2)"
    in_dn = "true" if far is None else f"l <= p1 + {far} * (p2 - p1)"
    return (f"CASE WHEN n < 2 OR NOT abs(p1 - p2) >= 2.5 * a THEN 0 WHEN k1 = 'H' AND l <= {up} AND c > {up} AND c > o AND {in_up} THEN 1 "
            f"WHEN k1 = 'L' AND h >= {dn} AND c < {dn} AND c < o AND {in_dn} THEN -1 ELSE 0 END")


def _wave(m: int, cond: str) -> str:
    return f"CASE WHEN n >= {m} AND brk AND ({cond}) THEN sd ELSE 0 END"


_H = " OR ".join(
    f"(({{0}}) BETWEEN {b[0]} AND {b[1]} AND ({{1}}) BETWEEN {c[0]} AND {c[1]} AND ({{2}}) BETWEEN {d[0]} AND {d[1]} AND ({{3}}) BETWEEN {e[0]} AND {e[1]})"
    for b, c, d, e in (((0.55, 0.70), (0.382, 0.886), (0.72, 0.86), (1.10, 1.80)), ((0.30, 0.55), (0.382, 0.886), (0.82, 0.95), (1.50, 2.80)),
                       ((0.70, 0.86), (0.382, 0.886), (1.18, 1.70), (1.50, 2.50)), ((0.30, 0.70), (0.382, 0.886), (1.45, 1.80), (2.00, 4.00))))
SWING_RULES = {
    "fib_golden_pocket": (2, _ret(0.618, 0.67)), "fib_retrace_382": (2, _ret(0.382)), "fib_retrace_500": (2, _ret(0.5)),
    "fib_retrace_618": (2, _ret(0.618)), "fib_retrace_786": (2, _ret(0.786)),
    "elliott_w2_w3": (3, _wave(3, "q2 - q3 >= 2.5 * a AND q1 > q3 AND (q2 - q1) / (q2 - q3) BETWEEN 0.382 AND 0.786")),
    "elliott_w4_w5": (5, _wave(5, "q4 - q5 >= 2.5 * a AND q3 > q5 AND q2 > q4 AND q1 > q4 AND (q4 - q3) / (q4 - q5) BETWEEN 0.382 AND 0.786 AND (q2 - q1) / (q2 - q3) BETWEEN 0.236 AND 0.5")),
    "elliott_abc": (4, _wave(4, "q4 - q3 >= 2.5 * a AND q2 < q4 AND q1 < q3 AND (q2 - q3) / (q4 - q3) BETWEEN 0.382 AND 0.786 AND (q2 - q1) / (q4 - q3) BETWEEN 0.618 AND 1.618")),
    "harmonic_prz": (5, _wave(5, "q4 - q5 >= 2.5 * a AND q4 > q3 AND q2 > q3 AND (" + _H.format("(q4 - q3) / (q4 - q5)", "(q2 - q3) / (q4 - q3)", "(q4 - q1) / (q4 - q5)", "(q2 - q1) / (q2 - q3)") + ")")),
}
_hold = Recur()
for _n, _rule in enumerate(SWING_RULES):
    _new = f"(x.e{_n} <> 0 AND x.e{_n} <> r.t{_n})"
    _pos, _until = f"(CASE WHEN {_new} THEN x.e{_n} ELSE r.t{_n} END)", f"(CASE WHEN {_new} THEN x.i + 12 ELSE r.u{_n} END)"
    _hold.raw(f"t{_n}", "0", f"CASE WHEN {_pos} <> 0 AND x.i >= {_until} THEN 0 ELSE {_pos} END")
    _hold.raw(f"u{_n}", "-1", f"CASE WHEN {_pos} <> 0 AND x.i >= {_until} THEN -1 ELSE {_until} END")
SWINGS_SQL = f"""WITH RECURSIVE {walk()},
{LAGS},
{ATR},
q AS MATERIALIZED (SELECT *, {pivots(3)}, {ranges((3,))} FROM xa),
{_sw.sql('q', 'r1', 'w1')},
w2 AS MATERIALIZED (SELECT *, len(sw) AS n, sw[-1].k AS k1, {', '.join(f'{x} AS p{j}' for j, x in enumerate(_P, 1))}, CASE WHEN sw[-1].k = 'L' THEN 1 ELSE -1 END AS sd,
  {', '.join(f"CASE WHEN sw[-1].k = 'L' THEN {x} ELSE -{x} END AS q{j}" for j, x in enumerate(_P, 1))}, CASE WHEN sw[-1].k = 'L' THEN c > ph3 ELSE c < pl3 END AS brk FROM w1 WHERE a > 0),
w3 AS (SELECT symbol, i, sw, unnest([{', '.join(f"{{'r': {j}, 'm': {m}, 'e': coalesce({e}, 0)}}" for j, (m, e) in enumerate(SWING_RULES.values()))}]) AS z FROM w2),
w4 AS (SELECT symbol, i, z.r AS r, z.e AS e, row_number() OVER (PARTITION BY symbol, z.r, array_to_string([y.j FOR y IN sw[-z.m:]], '-') ORDER BY i) AS k FROM w3 WHERE z.e <> 0),
w5 AS MATERIALIZED (SELECT b.symbol, b.timeframe, b.t, b.i, {', '.join(f'coalesce(max(e) FILTER (r = {j}), 0) AS e{j}' for j in range(9))} FROM q b LEFT JOIN (SELECT * FROM w4 WHERE k = 1) w ON w.symbol = b.symbol AND w.i = b.i GROUP BY 1, 2, 3, 4),
{_hold.sql('w5', 'r2', 'f')},
g AS (SELECT symbol, timeframe, t, i, unnest([{', '.join(f"{{'id': '{r}', 'p': t{j}}}" for j, r in enumerate(SWING_RULES))}]) AS z FROM f),
v AS (SELECT symbol, timeframe, z.id AS strategy_id, t, z.p AS sig, lag(z.p) OVER (PARTITION BY symbol, z.id ORDER BY i) AS ps FROM g)
SELECT symbol, timeframe, strategy_id, t, CAST(sig AS BIGINT) AS sig FROM v WHERE sig <> 0 OR coalesce(ps, 0) <> 0"""
