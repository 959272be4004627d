"""Current signals, proximity to a trigger, paper intents and the paper journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions.study import Study
from barlight.operators import layout as L
from barlight.plans.boards import status_rank
from barlight.session import TIMEFRAME_MS
from barlight.strategies.registry import TARGET, pick, signals

REFERENCE_NOTIONAL, ROUND_TRIP = 1000.0, 0.0014


def timeframe_ms(tf: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in TIMEFRAME_MS.items() for x in kv])[tf]


def direction_name(side: Column) -> Column:
    return F.when(side > 0, "LONG").when(side < 0, "SHORT").otherwise("FLAT")


def current_signals(bars: DataFrame, ids: list[str], longest: int | None = None) -> DataFrame:
    """State of each strategy on the last closed bar of each series.

    Age counts bars since the last signal (or last change of a target).
    """
    chosen = pick(ids)
    spark = bars.sparkSession
    series = ["symbol", "timeframe"]
    rows = signals(bars, ids, longest)
    if L.BLOCK in rows.columns:
        rows = L.neighbour(rows, [*series, "strategy_id"], "t", {"_p": "sig"}, L.BLOCK)
    else:
        rows = rows.withColumn("_p", F.lag("sig").over(Window.partitionBy(*series, "strategy_id").orderBy("t")))
    # A target row counts only where the position changed.
    moves = rows.where((F.col("mode") != TARGET) | (F.col("sig") != F.coalesce("_p", F.lit(0))))
    last = moves.groupBy(*series, "strategy_id").agg(F.max("t").alias("signal_t"), F.max_by("sig", "t").alias("state"))
    ends = bars.groupBy(*series).agg(F.max("t").alias("last_t"), F.count("*").alias("bars_used"))
    names = F.broadcast(spark.createDataFrame([(s.id, s.mode) for s in chosen], "strategy_id string, mode string"))
    full = ends.crossJoin(names).join(last, [*series, "strategy_id"], "left")
    # The signal bar's row number tells its age: one row per stream is looked up.
    at = L.with_index(bars).select(*series, F.col("t").alias("signal_t"), F.col(L.INDEX).alias("_i"))
    out = full.join(at, [*series, "signal_t"], "left")
    state = F.coalesce("state", F.lit(0))
    age = F.col("bars_used") - 1 - F.col("_i")
    fresh = F.coalesce(age == 0, F.lit(False))
    action = (F.when(state == 1, F.when(fresh, "ENTER_LONG").otherwise("HOLD_LONG"))
              .when(state == -1, F.when(fresh, "ENTER_SHORT").otherwise("HOLD_SHORT"))
              .when((F.col("mode") == TARGET) & fresh, "EXIT_TO_FLAT").otherwise("FLAT"))
    return out.select(*series, "strategy_id", "mode", direction_name(state).alias("direction"), state.alias("state"),
                      action.alias("action"), fresh.alias("fresh"), age.alias("age"), "signal_t", "last_t", "bars_used")


def canonical_entry(current: DataFrame, bars: DataFrame, open_bars: DataFrame) -> DataFrame:
    """Open of the bar after the signal, or of the running bar that follows it directly."""
    series = ["symbol", "timeframe"]
    rows = L.with_index(bars).select(*series, "t", "o", L.INDEX)
    marks = current.select(*series, "strategy_id", "signal_t").where(F.col("signal_t").isNotNull())
    at = marks.join(rows.select(*series, F.col("t").alias("signal_t"), (F.col(L.INDEX) + 1).alias("_n")), [*series, "signal_t"])
    after = rows.select(*series, F.col(L.INDEX).alias("_n"), F.col("t").alias("ct"), F.col("o").alias("co"))
    closed = at.join(after, [*series, "_n"]).drop("_n", "signal_t")
    running = open_bars.select(*series, F.col("t").alias("ot"), F.col("o").alias("oo"))
    rows = current.join(closed, [*series, "strategy_id"], "left").join(running, series, "left")
    joins = (F.col("signal_t") == F.col("last_t")) & (F.col("ot") == F.col("last_t") + timeframe_ms(F.col("timeframe")))
    return rows.withColumns({
        "entry_t": F.coalesce("ct", F.when(joins, F.col("ot"))), "entry_o": F.coalesce("co", F.when(joins, F.col("oo"))),
    }).drop("ct", "co", "ot", "oo")


def evidence_flags() -> Column:
    return F.array_compact(F.array(
        F.when(F.coalesce("trades", F.lit(0)) < 10, "THIN_SAMPLE"), F.when(F.coalesce("pf", F.lit(0.0)) > 8, "EXTREME_PF"),
        F.when(F.coalesce("dd", F.lit(0.0)) > 0.45, "HIGH_DD"),
        F.when(F.coalesce("net", F.lit(0.0)) > 5, "EXTREME_COMPOUNDING")))


def with_action_status(rows: DataFrame, selected_cohort: bool = False) -> DataFrame:
    """Row status from market status, evidence and signal age, then direction conflicts.

    ``rows`` has underlying, execution_status, contract, timeframe, direction,
    age, bars_used and the evidence columns.
    """
    known = F.col("timeframe").isin(*TIMEFRAME_MS)
    blocked = F.col("execution_status").isin("BLOCK", "NO_MARKET_SNAPSHOT")
    recent = F.when(F.col("timeframe").isin("1m", "5m"), 3).otherwise(1)
    strict = F.lit(not selected_cohort)
    flagged = rows.withColumn("evidence_flags", evidence_flags())
    status = (
        F.when(~known, "UNSUPPORTED_TIMEFRAME").when(F.col("contract").isNull(), "NO_MARKET_SNAPSHOT")
        .when(F.coalesce("bars_used", F.lit(0)) < 20, F.when(blocked, "BLOCKED").otherwise("NO_CANDLES"))
        .when(blocked, "BLOCKED").when(F.coalesce("direction", F.lit("FLAT")) == "FLAT", "FLAT")
        .when(strict & (F.col("execution_status") == "REVIEW"), "OBSERVE_ONLY")
        .when(strict & (F.size("evidence_flags") > 0), "EVIDENCE_REVIEW")
        .when(F.col("age") == 0, "FRESH_ENTRY").when(F.col("age") <= recent, "RECENT_SIGNAL").otherwise("ACTIVE_TREND"))
    return with_conflicts(flagged.withColumn("status", status))


def with_conflicts(rows: DataFrame) -> DataFrame:
    """Mark underlyings whose fresh signals disagree.

    A pre-aggregated flag per underlying is joined back, so a busy underlying
    is never gathered in one window.
    """
    fresh = rows.where((F.col("age") == 0) & F.col("direction").isin("LONG", "SHORT"))
    flags = fresh.groupBy("underlying").agg((F.min("direction") != F.max("direction")).alias("direction_conflict"))
    joined = rows.join(flags, "underlying", "left").na.fill(False, ["direction_conflict"])
    hit = F.col("direction_conflict") & F.col("status").isin("FRESH_ENTRY", "RECENT_SIGNAL")
    return joined.withColumn("status", F.when(hit, "DIRECTION_CONFLICT").otherwise(F.col("status")))


def _lead(rows: DataFrame, ranked_by_status: bool) -> DataFrame:
    first = (-status_rank(F.col("execution_status"))) if ranked_by_status else F.lit(0)
    order = F.struct(first.alias("a"), (-F.col("trades")).alias("b"), (-F.col("net")).alias("c"), "strategy_id", "timeframe")
    cols = ("contract", "execution_status", "strategy_id", "timeframe", "signal_t", "entry_o", "entry_t")
    one = rows.groupBy("underlying").agg(
        F.min("direction").alias("direction"), F.max("direction").alias("_d2"), F.count("*").alias("support"),
        F.min_by(F.struct(*cols), order).alias("r"),
        F.sort_array(F.collect_set(F.concat_ws(":", "strategy_id", "timeframe"))).alias("supporting"))
    return one.where("direction = _d2").select("underlying", "direction", "support", "supporting", "r.*")


def paper_intents(rows: DataFrame) -> DataFrame:
    """One intent per underlying whose fresh entries agree and have a price."""
    queue = rows.where((F.col("status") == "FRESH_ENTRY") & ~F.col("direction_conflict"))
    ready = F.col("entry_o").isNotNull() & F.col("entry_t").isNotNull()
    return _lead(queue, True).where(ready).withColumn("source", F.lit("FRESH"))


def catchup_intents(rows: DataFrame, previous_snapshot: int, fresh: DataFrame) -> DataFrame:
    """Fresh intents, and for other underlyings the latest entry after the previous snapshot."""
    skip = ["BLOCKED", "OBSERVE_ONLY", "EVIDENCE_REVIEW", "DIRECTION_CONFLICT", "NO_CANDLES"]
    ok = rows.where(
        F.col("direction").isin("LONG", "SHORT") & F.col("entry_o").isNotNull() & (F.col("entry_t") > previous_snapshot)
        & F.col("execution_status").isin("STRONG", "TRADEABLE") & (F.size("evidence_flags") == 0)
        & ~F.col("direction_conflict") & ~F.col("status").isin(*skip))
    newest = ok.groupBy("underlying").agg(F.max("entry_t").alias("_m"))
    latest = ok.join(newest, "underlying").where(F.col("entry_t") == F.col("_m"))
    late = _lead(latest, False).withColumn("source", F.lit("CATCHUP_RECENT"))
    return fresh.unionByName(late.join(fresh.select("underlying"), "underlying", "left_anti"))


def reconciliation_feed(states: DataFrame, snapshot_intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signal rows and intents in journal form from the two feed tables."""
    rows = states.select("underlying", F.col("symbol").alias("contract"), "strategy_id", "timeframe", "direction",
                         "action", "fresh", "entry_t", "entry_o", "mark")
    intents = snapshot_intents.select("underlying", "direction", F.col("price").alias("entry_o"),
                                      F.col("time").alias("entry_t"), F.lit("RECONCILIATION").alias("source"))
    return rows, intents


def mark_price() -> Column:
    """Mid, else last, else the mean of bid and ask; positive only."""
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(good("mid"), good("last"), (good("bid") + good("ask")) / 2)


def gross_return(side: Column, entry: Column, exit: Column) -> Column:
    ok = (entry > 0) & (exit > 0)
    return F.when(ok & (side > 0), exit / entry - 1).when(ok & (side < 0), entry / exit - 1).otherwise(0.0)


def paper_journal(intents: DataFrame, marks: DataFrame | None = None, chunk: str | None = None,
                  cost: float = ROUND_TRIP, notional: float = REFERENCE_NOTIONAL) -> DataFrame:
    """All paper trades of an intent log (underlying, t, side, price), open ones marked.

    Same-side intents support the position, opposite ones reverse it, side 0
    closes it.  ``chunk`` names a time-chunk column for very long logs.
    """
    seen = L.neighbour(intents, ["underlying"], "t", {"_p": "side"}, chunk)
    turns = seen.where(F.col("side") != F.coalesce("_p", F.lit(0))).drop("_p")
    ended = L.neighbour(turns, ["underlying"], "t", {"_xt": "t", "_xp": "price", "_xs": "side"}, chunk, ahead=True)
    held = ended.where("side <> 0")
    if marks is not None:
        held = held.join(marks.select("underlying", F.when(F.col("mark") > 0, F.col("mark")).alias("mark")), "underlying", "left")
    else:
        held = held.withColumn("mark", F.lit(None).cast("double"))
    is_open = F.col("_xt").isNull()
    price = F.coalesce("_xp", "mark")
    gross = F.round(F.when(price.isNotNull(), gross_return(F.col("side"), F.col("price"), price)), 10)
    net = F.round(gross - cost, 10)
    reason = F.when(is_open, F.lit(None).cast("string")).when(F.col("_xs") == 0, "TARGET_FLAT").otherwise("REVERSE_SIGNAL")
    return held.select("underlying", "side", F.col("t").alias("entry_t"), F.col("price").alias("entry_price"),
                       F.col("_xt").alias("exit_t"), F.col("_xp").alias("exit_price"), reason.alias("reason"),
                       is_open.alias("is_open"), "mark", gross.alias("gross"), net.alias("net"),
                       F.round(net * notional, 10).alias("pnl"))


def latest_events(trades: DataFrame, keep: int = 1000) -> DataFrame:
    """The newest closed trades, as many as the journal keeps."""
    return trades.where("NOT is_open").orderBy(F.desc("exit_t"), "underlying").limit(keep)


def journal_summary(trades: DataFrame, notional: float = REFERENCE_NOTIONAL) -> DataFrame:
    """Counts and sums; closes forced by infrastructure are not results."""
    valid = ~F.col("is_open") & (F.col("reason") != "TRADABILITY_BLOCK")
    bad = ~F.col("is_open") & (F.col("reason") == "TRADABILITY_BLOCK")
    net, pnl, op = F.col("net"), F.col("pnl"), F.col("is_open")
    total = lambda on, x: F.round(F.coalesce(F.sum(F.when(on, x)), F.lit(0.0)), 10)
    s = trades.agg(
        F.count_if(op).alias("open_positions"), F.count_if(valid).alias("closed"), F.count_if(bad).alias("infrastructure_closes"),
        F.count_if(valid & (net > 0)).alias("wins"), F.count_if(valid & (net < 0)).alias("losses"),
        total(valid, net).alias("realised_net"), total(valid, pnl).alias("realised_pnl"),
        total(op, net).alias("unrealised_net"), total(op, pnl).alias("unrealised_pnl"))
    closed_ref, open_ref = F.col("closed") * notional, F.col("open_positions") * notional
    return s.withColumns({
        "win_rate": F.when(F.col("closed") > 0, F.round(F.col("wins") / F.col("closed"), 10)).otherwise(0.0),
        "return_on_closed": F.when(closed_ref > 0, F.round(F.col("realised_pnl") / closed_ref, 10)).otherwise(0.0),
        "return_on_open": F.when(open_ref > 0, F.round(F.col("unrealised_pnl") / open_ref, 10)).otherwise(0.0)})


# --- proximity -----------------------------------------------------------------------

# Display classes of the score.
CLASSES = ((100, "TETIK/WAIT_CLOSE"), (80, "COK_YAKIN"), (60, "YAKIN"), (30, "ORTA"))
RANGE_CLASSES = ((100, "TETIK_KOSULU_PREVIEW"), (80, "ACILMAYA_COK_YAKIN"), (60, "YAKIN"), (30, "ORTA"))


def score_class(score: Column, classes=CLASSES) -> Column:
    out = F.when(score >= classes[0][0], classes[0][1])
    for least, name in classes[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("UZAK")


def closeness(distance: Column, scale: Column) -> Column:
    """1 at the level, falling to 0 one scale away."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), distance) / scale))


def _score(parts: list[tuple[Column, float, Column | None, str]]) -> tuple[Column, Column]:
    """``parts``: condition, points, closeness for part points, and what is missing."""
    total, missing = F.lit(0.0), []
    for done, points, near, name in parts:
        part = F.lit(0.0) if near is None else points * near
        total = total + F.when(done, F.lit(float(points))).otherwise(part)
        missing.append(F.when(~done, name))
    text = F.concat_ws(" + ", *missing)
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)) + 0.5)
    return score, F.when(text == "", "ready").otherwise(text)


def proximity(bars: DataFrame, longest: int | None = None) -> DataFrame:
    """Score of the newest bar of each series towards seven entry rules, both sides.

    The newest bar may be the running one; nothing here is a signal.
    """
    from barlight.strategies import levels as V
    from barlight.functions.study import _Make

    s = Study.for_bars(bars, L.longest_series(bars) if longest is None else longest)
    o, h, l, c = (F.col(x) for x in ("o", "h", "l", "c"))
    a, prev = s.atr(14), s.lag("c")
    found: dict[str, tuple] = {}

    hi, lo = s.prior_high(72), s.prior_low(72)
    w = hi - lo
    low_edge, high_edge, scale = lo + 0.15 * w, hi - 0.15 * w, F.greatest(w * 0.20, c * 0.005)
    found["sr_range_edge"] = (
        w > 0, low_edge,
        [(l <= low_edge, 50, closeness(l - low_edge, scale), "range low-edge touch"), (c > o, 25, None, "bullish candle"),
         (c > prev, 25, None, "close > previous close")],
        high_edge,
        [(h >= high_edge, 50, closeness(high_edge - h, scale), "range high-edge touch"), (c < o, 25, None, "bearish candle"),
         (c < prev, 25, None, "close < previous close")])

    hi, lo = s.prior_high(24), s.prior_low(24)
    ls, ss = lo - 0.05 * a, hi + 0.05 * a
    found["sr_liquidity_sweep"] = (
        (a > 0) & hi.isNotNull(), ls,
        [(l < ls, 65, closeness(l - ls, a), "sweep below 24-bar low"), (c > lo, 35, closeness(lo - c, a), "reclaim above range low")],
        ss,
        [(h > ss, 65, closeness(ss - h, a), "sweep above 24-bar high"), (c < hi, 35, closeness(c - hi, a), "reclaim below range high")])

    poc, _, _ = s.profile()
    lt, st = poc - 0.6 * a, poc + 0.6 * a
    found["sr25_poc_mean_reversion"] = (
        (a > 0) & poc.isNotNull(), lt,
        [(c < lt, 65, closeness(c - lt, a), "close below POC-0.6ATR"), (c > o, 35, None, "bullish candle")],
        st,
        [(c > st, 65, closeness(st - c, a), "close above POC+0.6ATR"), (c < o, 35, None, "bearish candle")])

    x = V.camarilla(s)
    day_h, day_l, _ = s.prior_period("day")
    scale = F.greatest((day_h - day_l) * 0.25, c * 0.005)
    found["sr25_camarilla_h3_l3"] = (
        day_h.isNotNull(), x["l3"],
        [(l <= x["l3"], 55, closeness(l - x["l3"], scale), "touch L3"), (c > x["l3"], 30, closeness(x["l3"] - c, scale), "close > L3"),
         (c < x["h4"], 15, None, "close < H4")],
        x["h3"],
        [(h >= x["h3"], 55, closeness(x["h3"] - h, scale), "touch H3"), (c < x["h3"], 30, closeness(c - x["h3"], scale), "close < H3"),
         (c > x["l4"], 15, None, "close > L4")])

    # States as they were before the newest bar.
    s.lag("h", 2)
    s.lag("l", 2)
    s.sma("v", 20)
    s.scan(_Make(_GapState), ["h_lag2", "l_lag2", "h", "l", "c"], ["gap_dir", "gap_lo", "gap_hi"])
    s.scan(_Make(_BlockState), [V.ATR, "sma_v_20", "o", "h", "l", "c", "v"], ["ob_dir", "ob_lo", "ob_hi"])
    s.pivot_marks(3, 3)
    s.scan(_Make(_LineState), ["pvh_3_3", "pvl_3_3"], ["up_now", "up_prev", "up_off", "dn_now", "dn_prev", "dn_off"])

    gd, glo, ghi = F.col("gap_dir"), F.col("gap_lo"), F.col("gap_hi")
    width = F.greatest(ghi - glo, c * 0.002) * 2
    gap = (
        F.lit(True), ghi,
        [((l <= ghi) & (h >= glo), 65, closeness(l - ghi, width), "touch bullish FVG"), (c > glo, 35, closeness(glo - c, width), "close > FVG low")],
        glo,
        [((h >= glo) & (l <= ghi), 65, closeness(glo - h, width), "touch bearish FVG"), (c < ghi, 35, closeness(c - ghi, width), "close < FVG high")])
    bd, blo, bhi = F.col("ob_dir"), F.col("ob_lo"), F.col("ob_hi")
    width = F.greatest(bhi - blo, c * 0.002) * 3
    block = (
        F.lit(True), bhi,
        [(l <= bhi, 60, closeness(l - bhi, width), "retest bullish OB"), (c > bhi, 40, closeness(bhi - c, width), "close > OB high")],
        blo,
        [(h >= blo, 60, closeness(blo - h, width), "retest bearish OB"), (c < blo, 40, closeness(c - blo, width), "close < OB low")])
    up, dn = F.col("up_now") + 0.08 * a, F.col("dn_now") - 0.08 * a
    line = (
        F.lit(True), up,
        [(F.col("up_off") <= 0.35 * a, 20, None, "3rd pivot off trendline"), (prev <= F.col("up_prev"), 20, None, "previous close already wrong side"),
         (c > up, 60, closeness(up - c, 1.5 * a), "break threshold")],
        dn,
        [(F.col("dn_off") <= 0.35 * a, 20, None, "3rd pivot off trendline"), (prev >= F.col("dn_prev"), 20, None, "previous close already wrong side"),
         (c < dn, 60, closeness(c - dn, 1.5 * a), "break threshold")])

    frame = s.frame()
    cols = [k for k in frame.columns if k not in ("symbol", "timeframe", "i", "block")]
    newest = frame.groupBy("symbol", "timeframe").agg(F.max_by(F.struct(*cols), "t").alias("r")).select("symbol", "timeframe", "r.*")

    def sides(valid, long_level, long, short_level, short, long_on=None, short_on=None, off=("", "")):
        (ls_, lm), (ss_, sm) = _score(long), _score(short)
        none = F.lit(None).cast("double")
        if long_on is not None:
            ls_, lm = F.when(long_on, ls_).otherwise(0), F.when(long_on, lm).otherwise(off[0])
            ss_, sm = F.when(short_on, ss_).otherwise(0), F.when(short_on, sm).otherwise(off[1])
            long_level, short_level = F.when(long_on, long_level), F.when(short_on, short_level)
        no = "proximity unavailable"
        ok = F.coalesce(valid, F.lit(False))
        pick_ = lambda y, z: F.when(ok, y).otherwise(z)
        return [pick_(ls_, 0).cast("long").alias("long_score"), pick_(long_level, none).alias("long_level"), pick_(lm, no).alias("long_missing"),
                pick_(ss_, 0).cast("long").alias("short_score"), pick_(short_level, none).alias("short_level"), pick_(sm, no).alias("short_missing")]

    cells = [F.struct(F.lit(k).alias("strategy_id"), *sides(*v)) for k, v in found.items()]
    cells.append(F.struct(F.lit("sr25_fvg_first_touch").alias("strategy_id"), *sides(*gap, long_on=gd == 1, short_on=gd == -1, off=(
        F.when(gd == -1, "active FVG is bearish").otherwise("no active bullish FVG"),
        F.when(gd == 1, "active FVG is bullish").otherwise("no active bearish FVG")))))
    cells.append(F.struct(F.lit("sr25_impulse_ob_retest").alias("strategy_id"), *sides(*block, long_on=bd == 1, short_on=bd == -1, off=(
        F.when(bd == -1, "active order block is bearish").otherwise("no active impulse order block"),
        F.when(bd == 1, "active order block is bullish").otherwise("no active impulse order block")))))
    cells.append(F.struct(F.lit("sr25_trendline_breakout").alias("strategy_id"), *sides(
        *line, long_on=F.col("up_now").isNotNull() & (a > 0), short_on=F.col("dn_now").isNotNull() & (a > 0),
        off=("need 3 confirmed pivots", "need 3 confirmed pivots"))))
    out = newest.select("symbol", "timeframe", "t", "c", F.explode(F.array(*cells)).alias("x")).select("symbol", "timeframe", "t", "c", "x.*")
    best = F.greatest("long_score", "short_score")
    return out.withColumns({"closest": F.when(F.col("long_score") >= F.col("short_score"), "LONG").otherwise("SHORT"),
                            "score": best, "class": score_class(best)})


class _GapState:
    """Newest gap still open before this bar; a touch that fails to hold keeps it."""

    def __init__(self):
        self.dir, self.lo, self.hi = 0.0, float("nan"), float("nan")

    def step(self, h2, l2, h, l, c):
        before = (self.dir, self.lo, self.hi)
        if l > h2:
            self.dir, self.lo, self.hi = 1.0, h2, l
        elif h < l2:
            self.dir, self.lo, self.hi = -1.0, h, l2
        elif l <= self.hi and h >= self.lo and (c > self.lo if self.dir > 0 else c < self.hi):
            self.dir = 0.0
        return before


class _BlockState:
    """Impulse block armed before this bar."""

    def __init__(self):
        from barlight.strategies.steps import ImpulseBlock

        self.rule = ImpulseBlock()

    def step(self, *row):
        z = self.rule.zone
        live = z.dir if z.left >= 0 else 0
        before = (float(live), z.lo, z.hi)
        self.rule.step(*row)
        return before


class _LineState:
    """Line of the last three pivots known before this bar, at this bar and the one before."""

    def __init__(self):
        self.n = -1
        self.highs: list[tuple[int, float]] = []
        self.lows: list[tuple[int, float]] = []

    def _line(self, points):
        if len(points) < 3:
            return (float("nan"),) * 3
        (x1, y1), (x2, y2), (x3, y3) = points
        slope = (y2 - y1) / (x2 - x1)
        return y1 + slope * (self.n - x1), y1 + slope * ((self.n - 1) - x1), abs(y3 - (y1 + slope * (x3 - x1)))

    def step(self, ph, pl):
        self.n += 1
        out = (*self._line(self.highs), *self._line(self.lows))
        if ph == ph:
            self.highs = [*self.highs, (self.n - 3, ph)][-3:]
        if pl == pl:
            self.lows = [*self.lows, (self.n - 3, pl)][-3:]
        return out


def range_proximity(bars: DataFrame, lookback: int = 48, longest: int | None = None) -> DataFrame:
    """Every bar's score towards the range sweep: 60 points to the sweep, 40 for the reclaim."""
    s = Study.for_bars(bars, L.longest_series(bars) if longest is None else longest)
    a, hi, lo = s.atr(14), s.prior_high(lookback), s.prior_low(lookback)
    h, l, c = F.col("h"), F.col("l"), F.col("c")
    one = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    far = lambda d: F.greatest(F.lit(0.0), d / a)
    lt, st = lo - 0.05 * a, hi + 0.05 * a
    ls, ss = l < lt, h > st
    ld, sd = far(l - lt), far(st - h)
    zero = F.lit(0.0)
    long = F.when(ls, 60 + 40 * one(1 - F.greatest(zero, lo - c) / (0.5 * a))).otherwise(60 * one(1 - ld / 3))
    short = F.when(ss, 60 + 40 * one(1 - F.greatest(zero, c - hi) / (0.5 * a))).otherwise(60 * one(1 - sd / 3))
    rows = s.frame().where((a > 0) & hi.isNotNull()).select(
        "symbol", "timeframe", "t", F.floor(long + 0.5).alias("long_score"), F.floor(short + 0.5).alias("short_score"),
        ld.alias("long_distance"), sd.alias("short_distance"), ls.alias("long_swept"), ss.alias("short_swept"),
        (ls & (c > lo)).alias("long_reclaimed"), (ss & (c < hi)).alias("short_reclaimed"))
    best = F.greatest("long_score", "short_score")
    return rows.withColumns({"direction": F.when(F.col("long_score") >= F.col("short_score"), "LONG").otherwise("SHORT"),
                             "score": best, "label": score_class(best, RANGE_CLASSES)})
