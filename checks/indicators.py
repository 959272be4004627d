"""Moving statistics, recurrences, levels and features on walk bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions.study import Study
from barlight.operators import features as X
from barlight.strategies.levels import camarilla, central_range
from checks import strategy_sql as S
from checks.base import Recur, bars, bound, check, frame, lag_chain, num, prior, r6, walk

KEYS = "symbol, timeframe, t"


def _study(spark, sf, timeframe="15m") -> Study:
    return Study.for_bars(bars(spark, sf, timeframe), bound(spark, sf, timeframe))


def _lr(src: str, p: int) -> str:
    sx, sxx = (p - 1) * p / 2, (p - 1) * p * (2 * p - 1) / 6
    sy, sxy = f"({lag_chain(src, [1] * p)})", f"({lag_chain(src, range(p))})"
    slope = f"(({p} * {sxy} - {num(sx)} * {sy}) / {num(p * sxx - sx * sx)})"
    return f"({sy} - {slope} * {num(sx)}) / {p} + {slope} * {p - 1}"


MOVING = ("sma", "sd", "wma", "hma", "lr", "zl", "kern", "mfi", "roc", "sk", "skd", "ph", "pl", "med", "mean_f", "sd_f")


@check("moving_statistics", f"""WITH {walk()},
{S.LAGS},
{S.layers('x', ('s1', f"{S.mean('c', 20)} AS sma, {S.sd('c', 20)} AS sd, {S.wma('c', 10)} AS wma, {S.wma('c', 8)} AS w8, {S.wma('c', 16)} AS w16, {_lr('c', 14)} AS lr, {S.KERNEL} AS kern, "
     f"CASE WHEN tp > lag(tp) OVER w THEN tp * v ELSE 0.0 END AS fu, CASE WHEN tp < lag(tp) OVER w THEN tp * v ELSE 0.0 END AS fd, 100 * (c / lag(c, 12) OVER w - 1) AS roc, "
     f"CASE WHEN i >= 13 THEN CASE WHEN max(h) OVER {frame(-13, 0)} = min(l) OVER {frame(-13, 0)} THEN 50 ELSE 100 * (c - min(l) OVER {frame(-13, 0)}) / (max(h) OVER {frame(-13, 0)} - min(l) OVER {frame(-13, 0)}) END END AS sk, "
     f"{prior('max', 'h', 20)} AS ph, {prior('min', 'l', 20)} AS pl, median(v) OVER {frame(-48, -1)} AS med"),
     ('s2', f"2 * w8 - w16 AS hd, 2 * lr - ({_lr('lr', 14)}) AS zl, ({lag_chain('fu', [1] * 14)}) AS nu, ({lag_chain('fd', [1] * 14)}) AS nd, ({lag_chain('sk', [1] * 3)}) / 3 AS skd, "
      f"list(wma) OVER {frame(-9, 0)} AS lw"),
     ('s3', f"{S.wma('hd', 4)} AS hma, CASE WHEN i < 13 THEN NULL WHEN nd = 0 THEN 100 ELSE 100 - 100 / (1 + nu / nd) END AS mfi, "
      "CASE WHEN i >= 18 THEN list_sum(lw) / 10 END AS mean_f"),
     ('s4', "CASE WHEN i >= 18 THEN sqrt(list_sum([(z - mean_f) * (z - mean_f) FOR z IN lw]) / 10) END AS sd_f"))}
SELECT {KEYS}, {', '.join(f'{r6(x)} AS {x}' for x in MOVING)} FROM s4""")
def _moving(spark, sf):
    s = _study(spark, sf)
    k, d = (s.stochastic())
    s.window("med", lambda w: F.percentile("v", 0.5).over(w.rowsBetween(-48, -1)), back=48)
    s.wma("c", 10)
    mean_f, sd_f = s.mean_sd_finite("wma_c_10", 10)
    cols = dict(sma=s.sma("c", 20), sd=s.stdev_pop("c", 20), wma=s.wma("c", 10), hma=s.hma("c", 16), lr=s.linreg("c", 14),
                zl=s.zlsma("c", 14), kern=s.kernel("c", 30), mfi=s.mfi(14), roc=s.roc("c", 12), sk=k, skd=d, ph=s.prior_high(20),
                pl=s.prior_low(20), med=F.col("med"), mean_f=mean_f, sd_f=sd_f)
    return s.frame().select("symbol", "timeframe", "t", *[c.alias(n) for n, c in cols.items()])


_rec = (Recur().ema("ema", 12, "c").rma("rma", 10, "v").rma("atr", 14, "tr").rma("g", 14, "up").rma("s", 14, "dn").ema("e12", 12, "c").ema("e26", 26, "c")
        .rma("atx", 14, "tr").rma("pd", 14, "dmu").rma("md", 14, "dmd"))
_rec.raw("sig", "CAST(0 AS DOUBLE)", f"{num(0.2)} * {S._macd} + {num(0.8)} * r.sig")
_dx = Recur().raw("adx", "CAST(0 AS DOUBLE)", "CASE WHEN x.i < 13 THEN 0.0 WHEN x.i < 26 THEN r.adx + x.dx WHEN x.i = 26 THEN (r.adx + x.dx) / 14 "
                  "ELSE (r.adx * 13 + x.dx) / 14 END", "CASE WHEN i >= 26 THEN adx END")
RECURRENT = ("tr", "ema", "rma", "atr", "rsi", "macd", "sig", "adx", "pdi", "mdi")


@check("recurrent_indicators", f"""WITH RECURSIVE {walk()},
{S.LAGS},
{S.DM},
{_rec.sql('d', 'r1', 'p')},
p2 AS MATERIALIZED (SELECT *, e12 - e26 AS macd, CASE WHEN g IS NULL THEN NULL WHEN s = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / s) END AS rsi,
  CASE WHEN atx > 0 THEN 100 * pd / atx END AS pdi, CASE WHEN atx > 0 THEN 100 * md / atx END AS mdi FROM p),
p3 AS MATERIALIZED (SELECT *, CASE WHEN pdi IS NULL THEN NULL WHEN pdi + mdi = 0 THEN 0.0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM p2),
{_dx.sql('p3', 'r2', 'f')}
SELECT {KEYS}, {', '.join(f'{r6(x)} AS {x}' for x in RECURRENT)} FROM f""")
def _recurrent(spark, sf):
    s = _study(spark, sf)
    m, g = s.macd()
    x, p, q = s.adx()
    cols = dict(tr=s.true_range(), ema=s.ema("c", 12), rma=s.rma("v", 10), atr=s.atr(14), rsi=s.rsi("c", 14), macd=m, sig=g, adx=x, pdi=p, mdi=q)
    return s.frame().select("symbol", "timeframe", "t", *[c.alias(n) for n, c in cols.items()])


_TRAIL = S.TRAILING_SQL[:S.TRAILING_SQL.rindex(",\nf AS (")]


@check("trailing_indicators", f"""{_TRAIL}
SELECT {KEYS}, {r6('o1_m')} AS vidya, {r6('ln1')} AS ott, CAST(st_d AS DOUBLE) AS st_trend, {r6('CASE WHEN i < 9 THEN NULL WHEN st_d = 1 THEN st_l ELSE st_u END')} AS st_line FROM g2""")
def _trailing(spark, sf):
    s = _study(spark, sf)
    m, line = s.ott(2, 1.4, "ott")
    trend, st = s.supertrend()
    return s.frame().select("symbol", "timeframe", "t", m.alias("vidya"), line.alias("ott"), trend.alias("st_trend"), st.alias("st_line"))


@check("qqe_track", S.QQE_SQL)
def _qqe(spark, sf):
    s = _study(spark, sf)
    m, f = s.qqe(3.0, "q")
    return s.frame().select("symbol", "timeframe", "t", m.alias("ma"), f.alias("fast"))


LEVELS = ("r", "s", "dh", "dl", "dc", "wh", "wl", "mh", "poc", "vah", "val", "h3", "l4", "pvt", "bc", "tc", "ah", "al")


@check("price_levels", f"""WITH {walk()},
{S.LAGS},
{S.PIVOTED.replace('FROM xa', 'FROM x')},
{S.PROFILE},
{S._d},
{S._w},
{S._m},
f AS (SELECT b.*, dh, dl, dc, wh, wl, mh, poc, vah, val, dc + (dh - dl) * 1.1 / 4 AS h3, dc - (dh - dl) * 1.1 / 2 AS l4, (dh + dl + dc) / 3 AS pvt,
  least((dh + dl) / 2, 2 * ((dh + dl + dc) / 3) - (dh + dl) / 2) AS bc, greatest((dh + dl) / 2, 2 * ((dh + dl + dc) / 3) - (dh + dl) / 2) AS tc,
  CASE WHEN (b.t // 3600000) % 24 >= 8 THEN max(CASE WHEN (b.t // 3600000) % 24 < 8 THEN h END) OVER dd END AS ah,
  CASE WHEN (b.t // 3600000) % 24 >= 8 THEN min(CASE WHEN (b.t // 3600000) % 24 < 8 THEN l END) OVER dd END AS al
  FROM z b LEFT JOIN profiles p ON p.symbol = b.symbol AND p.d = b.t // 86400000 LEFT JOIN days ON days.symbol = b.symbol AND dk = b.{S._dk}
  LEFT JOIN weeks ON weeks.symbol = b.symbol AND wk = {S._wk.replace('t -', 'b.t -')} LEFT JOIN months ON months.symbol = b.symbol AND mk = {S._mk.replace('(t ', '(b.t ')}
  WINDOW dd AS (PARTITION BY b.symbol, b.t // 86400000 ORDER BY b.i))
SELECT {KEYS}, {', '.join(f'{r6(x)} AS {x}' for x in LEVELS)} FROM f""")
def _levels(spark, sf):
    s = _study(spark, sf)
    r, u = s.pivots(3, 3)
    (dh, dl, dc), (wh, wl, _), (mh, _, _) = (s.prior_period(x) for x in ("day", "week", "month"))
    poc, vah, val = s.profile()
    x, (pv, bc, tc) = camarilla(s), central_range(s)
    ah, al = s.session_range(0, 8)
    cols = dict(r=r, s=u, dh=dh, dl=dl, dc=dc, wh=wh, wl=wl, mh=mh, poc=poc, vah=vah, val=val, h3=x["h3"], l4=x["l4"], pvt=pv, bc=bc, tc=tc, ah=ah, al=al)
    return s.frame().select("symbol", "timeframe", "t", *[c.alias(n) for n, c in cols.items()])


@check("micro_break_anchored_vwap", f"""WITH {walk()},
{S.LAGS},
y AS (SELECT *, {prior('max', 'h', 20)} AS ph20, {prior('min', 'l', 20)} AS pl20, {prior('max', 'h', 3)} AS ph3, {prior('min', 'l', 3)} AS pl3 FROM x),
z AS (SELECT *, count(*) FILTER (c > ph20 OR c < pl20) OVER (PARTITION BY symbol ORDER BY i {S.ALL}) AS xg FROM y)
SELECT {KEYS}, CASE WHEN c > ph3 THEN 1 WHEN c < pl3 THEN -1 ELSE 0 END AS micro,
  CASE WHEN xg > 0 THEN {r6(f'(sum(tp * v) OVER (PARTITION BY symbol, xg ORDER BY i {S.ALL})) / (sum(v) OVER (PARTITION BY symbol, xg ORDER BY i {S.ALL}))')} END AS vwap FROM z""")
def _micro(spark, sf):
    from barlight.strategies.visual import structure_vwap

    s = _study(spark, sf)
    structure_vwap(s)
    micro = F.when(F.col("c") > s.prior_high(3), 1).when(F.col("c") < s.prior_low(3), -1).otherwise(0)
    return s.frame().select("symbol", "timeframe", "t", micro.alias("micro"), F.col("xv").alias("vwap"))


# --- features ------------------------------------------------------------------------


def _clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def _struct(p: int) -> str:
    oh, ol = f"max(h) OVER {frame(-2 * p, -p - 1)}", f"min(l) OVER {frame(-2 * p, -p - 1)}"
    nh, nl = f"max(h) OVER {frame(-p, -1)}", f"min(l) OVER {frame(-p, -1)}"
    return f"CASE WHEN i < {2 * p} THEN 0.0 WHEN {nh} > {oh} AND {nl} > {ol} THEN 1.0 WHEN {nh} < {oh} AND {nl} < {ol} THEN -1.0 ELSE 0.0 END"


FEATURES_CTE = f"""f1 AS MATERIALIZED (SELECT *, lag(c) OVER w AS pc, greatest(0.0, h - l) AS rng, max(h) OVER {frame(-48, -1)} AS lh, min(l) OVER {frame(-48, -1)} AS ll,
  list(h) OVER {frame(-48, -1)} AS lhs, list(l) OVER {frame(-48, -1)} AS lls, avg(h - l) OVER {frame(-48, -1)} AS la, list(h - l) OVER {frame(-12, -1)} AS srs,
  median(v) OVER {frame(-48, -1)} AS vm, {_struct(12)} AS ins, {_struct(48)} AS exs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
f2 AS MATERIALIZED (SELECT *, coalesce(nullif(la, 0), nullif(rng, 0), 1.0) AS al, coalesce(lh, h) AS ph, coalesce(ll, l) AS pl, i > 0 AS has FROM f1),
f3 AS MATERIALIZED (SELECT *, CASE WHEN has AND c > ph THEN 1.0 WHEN has AND c < pl THEN -1.0 ELSE 0.0 END AS bd, CASE WHEN has AND c > ph THEN ph WHEN has AND c < pl THEN pl END AS bl,
  CASE WHEN has AND h > ph AND c < ph THEN -{_clamp('(h - ph) / al', 0.0, 3.0)} WHEN has AND l < pl AND c > pl THEN {_clamp('(pl - l) / al', 0.0, 3.0)} ELSE 0.0 END AS sweep,
  CASE WHEN has AND h > ph AND c < ph THEN -{_clamp('(ph - c) / al', 0.0, 2.0)} WHEN has AND l < pl AND c > pl THEN {_clamp('(c - pl) / al', 0.0, 2.0)} ELSE 0.0 END AS recl,
  coalesce(nullif(CASE WHEN i > 0 THEN list_avg(srs) END, 0), al) AS sa FROM f2),
f4 AS MATERIALIZED (SELECT *, bd * {_clamp('abs(CASE WHEN bd = 1 THEN c - ph WHEN bd = -1 THEN c - pl ELSE 0.0 END) / al', 0.0, 3.0)} AS bos, lag(bd) OVER w AS pbd, lag(bl) OVER w AS pbl,
  lag(sweep) OVER w AS psw, lag(ins) OVER w AS pins, list_position(list_reverse([z >= al * 0.75 FOR z IN srs]), true) AS cut FROM f3 WINDOW w AS (PARTITION BY symbol ORDER BY i)),
feat AS MATERIALIZED (SELECT symbol, timeframe, t, i, o, h, l, c, v, ins AS InternalStructure, exs AS ExternalStructure, bos AS BOSStrength,
  CASE WHEN bd <> 0 AND exs <> 0 AND bd <> exs THEN bos ELSE 0.0 END AS CHOCHStrength,
  {_clamp(f"(CASE WHEN rng > 0 THEN greatest(h - greatest(o, c), least(o, c) - l) / rng ELSE 0 END) * (CASE WHEN has THEN 1 - {_clamp('least(abs(h - ph), abs(l - pl)) / al', 0.0, 1.0)} ELSE 0 END)", 0.0, 1.0)} AS SwingQuality,
  CASE WHEN has THEN {_clamp('(c - (ph + pl) / 2) / (greatest(ph - pl, 2.220446049250313e-16) / 2)', -1.0, 1.0)} ELSE 0.0 END AS RangeBoundary, bos AS BreakoutDisplacement,
  CASE WHEN has THEN (len([z FOR z IN lhs IF abs(z - c) <= al * 0.25]) + len([z FOR z IN lls IF abs(z - c) <= al * 0.25])) / (len(lhs) * 2) ELSE 0.0 END AS LiquidityDensity,
  sweep AS SweepDepth, recl AS ReclaimQuality, CASE WHEN psw <> 0 THEN {_clamp('(c - pc) / al', -3.0, 3.0)} ELSE 0.0 END AS PostSweepDisplacement,
  CASE WHEN psw <> 0 AND ins <> 0 AND ins <> pins THEN ins ELSE 0.0 END AS StructureShiftAfterSweep,
  CASE WHEN pbd <> 0 AND l <= pbl AND h >= pbl AND (CASE WHEN pbd > 0 THEN c >= pbl ELSE c <= pbl END) THEN pbd * {_clamp('1 - abs(c - pbl) / al', 0.0, 1.0)} ELSE 0.0 END AS RetestQuality,
  {_clamp('1 - sa / al', 0.0, 1.0)} AS CompressionDepth, CASE WHEN i > 0 THEN coalesce(nullif(cut, 0) - 1, len(srs)) / 12 ELSE 0.0 END AS CompressionDuration,
  {_clamp('rng / al * (CASE WHEN rng > 0 THEN abs(c - o) / rng ELSE 0 END)', 0.0, 4.0)} AS ExpansionVelocity, {_clamp('(ins + exs) / 2', -1.0, 1.0)} AS TrendRangeScore,
  CASE WHEN vm > 0 THEN v / vm ELSE 1.0 END AS RelativeVolume FROM f4)"""


@check("feature_vector", f"WITH {walk()},\n{FEATURES_CTE}\nSELECT {KEYS}, {', '.join(f'{r6(x)} AS {x}' for x in X.FEATURES)} FROM feat")
def _features(spark, sf):
    return X.features(bars(spark, sf), longest=bound(spark, sf)).select("symbol", "timeframe", "t", *X.FEATURES)


SIX = ", ".join(f"printf('%.6f', {r6(x)})" for x in X.FEATURES)


@check("feature_signature", f"""WITH {walk()},\n{FEATURES_CTE}
SELECT symbol, timeframe, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(t AS VARCHAR), {SIX})), 1, 8) AS BIGINT)) AS BIGINT) AS signature FROM feat GROUP BY 1, 2""")
def _signature(spark, sf):
    return X.feature_signature(X.features(bars(spark, sf), longest=bound(spark, sf)))


CONCEPT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS concept, '{d}' AS disposition, {len(f)} AS features, count(*) FILTER (WHERE {' AND '.join(f'{x} IS NOT NULL' for x in f) or 'false'}) AS defined_rows, "
    f"count(*) FILTER (WHERE {' OR '.join(f'{x} <> 0' for x in f) or 'false'}) AS active_rows FROM feat" for c, d, f in X.CONCEPTS)


@check("concept_coverage", f"WITH {walk()},\n{FEATURES_CTE}\n{CONCEPT_SQL}")
def _concepts(spark, sf):
    return X.concept_coverage(X.features(bars(spark, sf), longest=bound(spark, sf)))


SETUPS_CTE = """cand AS (SELECT *, lag(CompressionDepth) OVER w AS pdep, lag(CompressionDuration) OVER w AS pdur FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY i)),
ev AS MATERIALIZED (
  SELECT symbol, timeframe, t, i, c, 'breakout' AS kind, CASE WHEN BOSStrength >= 0 THEN 1 ELSE -1 END AS direction, abs(BOSStrength) AS strength, abs(BOSStrength) AS a, 0.0 AS b, 0.0 AS d FROM cand WHERE BOSStrength <> 0
  UNION ALL SELECT symbol, timeframe, t, i, c, 'liquidity_sweep_reclaim', CASE WHEN SweepDepth >= 0 THEN 1 ELSE -1 END, least(3.0, abs(SweepDepth) + abs(ReclaimQuality)), abs(SweepDepth), abs(ReclaimQuality), 0.0 FROM cand WHERE SweepDepth <> 0
  UNION ALL SELECT symbol, timeframe, t, i, c, 'compression_release', CASE WHEN c >= o THEN 1 ELSE -1 END, ExpansionVelocity * (1 + pdep), pdep, pdur, ExpansionVelocity FROM cand WHERE c <> o AND pdep IS NOT NULL)"""
FIRES = "(kind = 'breakout' AND a >= 0.2) OR (kind = 'liquidity_sweep_reclaim' AND a >= 0.15 AND b >= 0.05) OR (kind = 'compression_release' AND a >= 0.2 AND b >= 0.25 AND d >= 1.25)"


@check("setup_events", f"WITH {walk()},\n{FEATURES_CTE},\n{SETUPS_CTE}\nSELECT {KEYS}, kind, direction, {r6('strength')} AS strength FROM ev WHERE {FIRES}")
def _setups(spark, sf):
    rows = X.features(bars(spark, sf), longest=bound(spark, sf))
    return X.detect_setups(rows).select("symbol", "timeframe", "t", "kind", "direction", "strength")
