"""Current signals, proximity, paper journal, event decisions, ledgers and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import trades as T
from barlight.plans import decisions as D
from barlight.plans import monitor as M
from checks import strategy_sql as S
from checks.base import bars, bound, check, r6, table, walk
from checks.research import BY, IDS, signal_cte, signal_table

KEYS = BY.split(", ")
NOW = 1_706_659_200_000


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


# --- current state ------------------------------------------------------------------

CURRENT = f"""ls AS (SELECT {BY}, arg_max(sig, i) AS state, max(i) AS si, max(t) AS signal_t FROM sg GROUP BY 1, 2, 3),
en AS (SELECT symbol, timeframe, max(i) AS li, max(t) AS last_t, count(*) AS bars_used FROM bars GROUP BY 1, 2)"""


@check("current_signals", f"""WITH {walk()}, {signal_cte()}, {CURRENT} SELECT {BY}, CASE state WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, state,
  CASE WHEN li = si THEN 'ENTER_' ELSE 'HOLD_' END || CASE state WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS action, li = si AS fresh, li - si AS age, signal_t, last_t, bars_used FROM ls JOIN en USING (symbol, timeframe)""")
def _current(spark, sf):
    return M.current_signals(bars(spark, sf), IDS, bound(spark, sf)).drop("mode")


@check("canonical_entries", f"""WITH {walk()}, {signal_cte()}, {CURRENT} SELECT {BY}, nt AS entry_t, {r6('no')} AS entry_o FROM (
  SELECT l.symbol, l.timeframe, strategy_id, CASE WHEN b.t IS NULL THEN last_t + 900000 ELSE b.t END AS nt, CASE WHEN b.t IS NULL THEN c2 ELSE b.o END AS no
  FROM ls l JOIN en USING (symbol, timeframe) LEFT JOIN bars b ON b.symbol = l.symbol AND b.i = si + 1 JOIN (SELECT symbol, arg_max(c, i) AS c2 FROM bars GROUP BY 1) z ON z.symbol = l.symbol)""")
def _entries(spark, sf):
    b = bars(spark, sf)
    running = b.groupBy("symbol", "timeframe").agg((F.max("t") + 900_000).alias("t"), F.max_by("c", "t").alias("o"))
    return M.canonical_entry(M.current_signals(b, IDS, bound(spark, sf)), b, running).select(*KEYS, "entry_t", "entry_o")


# Watch rows: orders stand for (underlying, strategy) states of a monitor cycle.
ROWS = """wr AS MATERIALIZED (SELECT *, concat_ws(',', CASE WHEN trades < 10 THEN 'THIN_SAMPLE' END, CASE WHEN pf > 8 THEN 'EXTREME_PF' END, CASE WHEN dd > 0.45 THEN 'HIGH_DD' END, CASE WHEN net > 5 THEN 'EXTREME_COMPOUNDING' END) AS evidence_flags FROM (
  SELECT o_orderkey AS k, 'U' || (o_custkey % 700) AS underlying, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE 'U' || (o_custkey % 700) || 'USDT' END AS contract, 's' || (o_orderkey % 11) AS strategy_id,
    CASE o_orderkey % 5 WHEN 0 THEN '5m' WHEN 1 THEN '1h' WHEN 2 THEN '4h' WHEN 3 THEN '15m' ELSE '9h' END AS timeframe, CASE o_custkey % 700 % 6 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'TRADEABLE' WHEN 2 THEN 'TRADEABLE' WHEN 3 THEN 'REVIEW' WHEN 4 THEN 'BLOCK' ELSE 'STRONG' END AS execution_status,
    CASE o_orderkey % 7 WHEN 0 THEN 'FLAT' WHEN 1 THEN 'SHORT' ELSE 'LONG' END AS direction, o_orderkey % 4 AS age, CASE WHEN o_orderkey % 41 = 0 THEN 5 ELSE 500 END AS bars_used, 8 + o_orderkey % 30 AS trades,
    floor(o_totalprice) / 60000.0 AS pf, (o_orderkey % 50) / 100.0 AS dd, floor(o_totalprice) / 100000.0 AS net, epoch_ms(o_orderdate) AS signal_t, epoch_ms(o_orderdate) + 3600000 AS entry_t, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice END AS entry_o FROM orders)),
cf AS (SELECT underlying FROM wr WHERE age = 0 AND direction <> 'FLAT' GROUP BY 1 HAVING count(DISTINCT direction) > 1),
w1 AS (SELECT *, CASE WHEN timeframe = '9h' THEN 'UNSUPPORTED_TIMEFRAME' WHEN contract IS NULL THEN 'NO_MARKET_SNAPSHOT' WHEN bars_used < 20 THEN CASE WHEN execution_status = 'BLOCK' THEN 'BLOCKED' ELSE 'NO_CANDLES' END
  WHEN execution_status = 'BLOCK' THEN 'BLOCKED' WHEN direction = 'FLAT' THEN 'FLAT' WHEN execution_status = 'REVIEW' THEN 'OBSERVE_ONLY' WHEN evidence_flags <> '' THEN 'EVIDENCE_REVIEW' WHEN age = 0 THEN 'FRESH_ENTRY'
  WHEN age <= CASE WHEN timeframe = '5m' THEN 3 ELSE 1 END THEN 'RECENT_SIGNAL' ELSE 'ACTIVE_TREND' END AS st0, underlying IN (SELECT underlying FROM cf) AS direction_conflict FROM wr),
ws AS MATERIALIZED (SELECT *, CASE WHEN direction_conflict AND st0 IN ('FRESH_ENTRY', 'RECENT_SIGNAL') THEN 'DIRECTION_CONFLICT' ELSE st0 END AS status FROM w1)"""


def watch_rows(spark, sf):
    o = table(spark, sf, "orders")
    k, u, p = F.col("o_orderkey"), F.col("o_custkey") % 700, F.floor("o_totalprice")
    name = F.concat(F.lit("U"), u.cast("string"))
    pick = lambda x, *v: F.element_at(F.array(*[F.lit(y) for y in v]), (x + 1).cast("int"))
    rows = o.select(
        k.alias("k"), name.alias("underlying"), F.when(k % 37 != 0, F.concat(name, F.lit("USDT"))).alias("contract"), F.concat(F.lit("s"), (k % 11).cast("string")).alias("strategy_id"),
        pick(k % 5, "5m", "1h", "4h", "15m", "9h").alias("timeframe"), pick(u % 6, "STRONG", "TRADEABLE", "TRADEABLE", "REVIEW", "BLOCK", "STRONG").alias("execution_status"),
        F.when(k % 7 == 0, "FLAT").when(k % 7 == 1, "SHORT").otherwise("LONG").alias("direction"), (k % 4).alias("age"), F.when(k % 41 == 0, 5).otherwise(500).alias("bars_used"),
        (8 + k % 30).alias("trades"), (p / 60000).alias("pf"), (k % 50 / 100).alias("dd"), (p / 100000).alias("net"), ms("o_orderdate").alias("signal_t"),
        (ms("o_orderdate") + 3_600_000).alias("entry_t"), F.when(k % 53 != 0, F.col("o_totalprice")).alias("entry_o"))
    return M.with_action_status(rows)


@check("action_status", f"WITH {ROWS} SELECT k, underlying, status, evidence_flags, direction_conflict FROM ws")
def _status(spark, sf):
    return watch_rows(spark, sf).select("k", "underlying", "status", "evidence_flags", "direction_conflict")


LEADS = "CASE execution_status WHEN 'STRONG' THEN 3 WHEN 'TRADEABLE' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END"


def intents_sql(src: str, order: str, source: str) -> str:
    return f"""SELECT underlying, min(direction) AS direction, count(*) AS support, array_to_string(list_sort(list(DISTINCT strategy_id || ':' || timeframe)), ',') AS supporting,
  first(contract ORDER BY {order}) AS contract, first(execution_status ORDER BY {order}) AS execution_status, first(strategy_id ORDER BY {order}) AS strategy_id, first(timeframe ORDER BY {order}) AS timeframe,
  first(signal_t ORDER BY {order}) AS signal_t, first(entry_o ORDER BY {order}) AS entry_o, first(entry_t ORDER BY {order}) AS entry_t, '{source}' AS source FROM {src} GROUP BY 1 HAVING min(direction) = max(direction)"""


FRESH = f"""fq AS (SELECT * FROM ws WHERE status = 'FRESH_ENTRY' AND NOT direction_conflict), fi AS MATERIALIZED (SELECT * FROM ({intents_sql('fq', f'{LEADS} DESC, trades DESC, net DESC, strategy_id, timeframe', 'FRESH')}) WHERE entry_o IS NOT NULL)"""
I_COLS = "underlying, direction, support, supporting, contract, execution_status, strategy_id, timeframe, signal_t, " + r6("entry_o") + " AS entry_o, entry_t, source"


@check("paper_intents", f"WITH {ROWS}, {FRESH} SELECT {I_COLS} FROM fi")
def _intents(spark, sf):
    return M.paper_intents(watch_rows(spark, sf))


@check("catchup_intents", f"""WITH {ROWS}, {FRESH}, ok AS (SELECT * FROM ws WHERE direction <> 'FLAT' AND entry_o IS NOT NULL AND entry_t > 900000000000 AND execution_status IN ('STRONG', 'TRADEABLE') AND evidence_flags = '' AND NOT direction_conflict
  AND status NOT IN ('BLOCKED', 'OBSERVE_ONLY', 'EVIDENCE_REVIEW', 'DIRECTION_CONFLICT', 'NO_CANDLES')), nw AS (SELECT * FROM (SELECT *, max(entry_t) OVER (PARTITION BY underlying) AS m FROM ok) WHERE entry_t = m),
ct AS ({intents_sql('nw', 'trades DESC, net DESC, strategy_id, timeframe', 'CATCHUP_RECENT')}) SELECT {I_COLS} FROM fi UNION ALL SELECT {I_COLS} FROM ct WHERE underlying NOT IN (SELECT underlying FROM fi)""")
def _catchup(spark, sf):
    rows = watch_rows(spark, sf)
    return M.catchup_intents(rows, 900_000_000_000, M.paper_intents(rows))


@check("reconciliation_feed", f"WITH {ROWS} SELECT underlying, count(*) AS rows, count(entry_o) AS priced, max(entry_t) AS last_entry FROM ws GROUP BY 1")
def _feed(spark, sf):
    w = watch_rows(spark, sf).withColumns({"symbol": F.col("contract"), "action": F.lit("HOLD"), "fresh": F.col("age") == 0, "mark": F.col("entry_o"),
                                           "price": F.col("entry_o"), "time": F.col("entry_t")})
    rows, intents = M.reconciliation_feed(w, w)
    a = rows.groupBy("underlying").agg(F.count("*").alias("rows"))
    return a.join(intents.groupBy("underlying").agg(F.count("entry_o").alias("priced"), F.max("entry_t").alias("last_entry")), "underlying")


@check("range_proximity", f"""WITH RECURSIVE {walk()}, {S.LAGS}, {S.ATR}, p AS (SELECT *, {S.ranges((48,))} FROM xa),
q AS (SELECT *, pl48 - 0.05 * a AS lt, ph48 + 0.05 * a AS st FROM p WHERE a > 0 AND ph48 IS NOT NULL),
u AS (SELECT *, CASE WHEN l < lt THEN 60 + 40 * greatest(0.0, least(1.0, 1 - greatest(0.0, pl48 - c) / (0.5 * a))) ELSE 60 * greatest(0.0, least(1.0, 1 - greatest(0.0, (l - lt) / a) / 3)) END AS ls,
  CASE WHEN h > st THEN 60 + 40 * greatest(0.0, least(1.0, 1 - greatest(0.0, c - ph48) / (0.5 * a))) ELSE 60 * greatest(0.0, least(1.0, 1 - greatest(0.0, (st - h) / a) / 3)) END AS ss FROM q),
v AS (SELECT *, CAST(floor(ls + 0.5) AS BIGINT) AS long_score, CAST(floor(ss + 0.5) AS BIGINT) AS short_score FROM u)
SELECT symbol, timeframe, t, long_score, short_score, {r6('greatest(0.0, (l - lt) / a)')} AS long_distance, {r6('greatest(0.0, (st - h) / a)')} AS short_distance, l < lt AS long_swept, h > st AS short_swept,
  l < lt AND c > pl48 AS long_reclaimed, h > st AND c < ph48 AS short_reclaimed, CASE WHEN long_score >= short_score THEN 'LONG' ELSE 'SHORT' END AS direction, greatest(long_score, short_score) AS score,
  CASE WHEN greatest(long_score, short_score) >= 100 THEN 'TETIK_KOSULU_PREVIEW' WHEN greatest(long_score, short_score) >= 80 THEN 'ACILMAYA_COK_YAKIN' WHEN greatest(long_score, short_score) >= 60 THEN 'YAKIN'
    WHEN greatest(long_score, short_score) >= 30 THEN 'ORTA' ELSE 'UZAK' END AS label FROM v""")
def _range_prox(spark, sf):
    return M.range_proximity(bars(spark, sf), longest=bound(spark, sf))


@check("proximity")
def _prox(spark, sf):
    return M.proximity(bars(spark, sf), bound(spark, sf))


# Paper intents over time: orders by customer group.
LOG = """lg AS MATERIALIZED (SELECT underlying, t, side, price FROM (SELECT 'U' || (o_custkey % 200) AS underlying, epoch_ms(o_orderdate) + o_orderkey AS t, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN -1 ELSE 1 END AS side, round(100 + o_totalprice / 10000, 2) AS price FROM orders)),
lc AS (SELECT *, lag(side) OVER (PARTITION BY underlying ORDER BY t) AS ps FROM lg), ld AS (SELECT *, lead(t) OVER w AS xt, lead(price) OVER w AS xp, lead(side) OVER w AS xs FROM lc WHERE side <> coalesce(ps, 0) WINDOW w AS (PARTITION BY underlying ORDER BY t)),
mk AS (SELECT underlying, max(price) AS mark FROM lg GROUP BY 1),
pj AS MATERIALIZED (SELECT underlying, side, entry_t, entry_price, exit_t, exit_price, reason, is_open, mark, gross, round(gross - 0.0014, 10) AS net, round(round(gross - 0.0014, 10) * 1000, 10) AS pnl FROM (
  SELECT ld.underlying, side, t AS entry_t, price AS entry_price, xt AS exit_t, xp AS exit_price, CASE WHEN xt IS NULL THEN NULL WHEN xs = 0 THEN 'TARGET_FLAT' ELSE 'REVERSE_SIGNAL' END AS reason, xt IS NULL AS is_open, mark,
    round(CASE WHEN side = 1 THEN coalesce(xp, mark) / price - 1 ELSE price / coalesce(xp, mark) - 1 END, 10) AS gross FROM ld JOIN mk ON mk.underlying = ld.underlying WHERE side <> 0))"""


def intent_log(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(F.concat(F.lit("U"), (F.col("o_custkey") % 200).cast("string")).alias("underlying"), (ms("o_orderdate") + k).alias("t"),
                    F.when(k % 5 == 0, 0).when(k % 5 < 3, -1).otherwise(1).alias("side"), F.round(100 + F.col("o_totalprice") / 10000, 2).alias("price"))


def journal(spark, sf):
    log = intent_log(spark, sf).withColumn("year", F.floor(F.col("t") / 31_536_000_000))
    return M.paper_journal(log, log.groupBy("underlying").agg(F.max("price").alias("mark")), chunk="year")


P_COLS = f"underlying, side, entry_t, {r6('entry_price')} AS entry_price, coalesce(exit_t, -1) AS exit_t, {r6('exit_price')} AS exit_price, reason, is_open, {r6('mark')} AS mark, {r6('gross')} AS gross, {r6('net')} AS net"


@check("paper_journal", f"WITH {LOG} SELECT {P_COLS} FROM pj")
def _journal(spark, sf):
    return _shown(journal(spark, sf))


def _shown(trades):
    # -1 stands for "still open"; profit is checked in the summary.
    return trades.withColumn("exit_t", F.coalesce("exit_t", F.lit(-1))).drop("pnl")


@check("journal_recent", f"WITH {LOG} SELECT {P_COLS} FROM pj WHERE NOT is_open ORDER BY exit_t DESC, underlying LIMIT 1000")
def _recent(spark, sf):
    return _shown(M.latest_events(journal(spark, sf)))


@check("journal_summary", f"""WITH {LOG} SELECT count(*) FILTER (is_open) AS open_positions, count(*) FILTER (NOT is_open) AS closed, 0 AS infrastructure_closes, count(*) FILTER (NOT is_open AND net > 0) AS wins, count(*) FILTER (NOT is_open AND net < 0) AS losses,
  {r6('sum(net) FILTER (NOT is_open)')} AS realised_net, {r6('sum(pnl) FILTER (NOT is_open)')} AS realised_pnl, {r6('sum(net) FILTER (is_open)')} AS unrealised_net, {r6('sum(pnl) FILTER (is_open)')} AS unrealised_pnl,
  {r6('count(*) FILTER (NOT is_open AND net > 0) / count(*) FILTER (NOT is_open)')} AS win_rate, {r6('sum(pnl) FILTER (NOT is_open) / (count(*) FILTER (NOT is_open) * 1000)')} AS return_on_closed,
  {r6('sum(pnl) FILTER (is_open) / (count(*) FILTER (is_open) * 1000)')} AS return_on_open FROM pj""")
def _summary(spark, sf):
    return M.journal_summary(journal(spark, sf))


@check("reference_positions", f"WITH {LOG.replace('gross - 0.0014', 'gross - 0.0')} SELECT underlying, side, entry_t, coalesce(exit_t, -1) AS exit_t, reason, {r6('CASE WHEN NOT is_open THEN gross END')} AS gross FROM pj")
def _reference(spark, sf):
    log = intent_log(spark, sf)
    bad = log.withColumns({"price": F.lit(0.0), "t": F.col("t") + 1, "side": -F.col("side")})
    return _shown(D.reference_positions(log.unionByName(bad))).select("underlying", "side", "entry_t", "exit_t", "reason", "gross")


@check("mark_prices", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN c_acctbal WHEN c_custkey % 3 = 1 AND c_acctbal > 0 THEN c_acctbal + 1 WHEN c_acctbal > 0 THEN (c_acctbal + c_acctbal + 4) / 2 END AS mark FROM customer""")
def _mark(spark, sf):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 3 == 0, b).otherwise(-1.0).alias("mid"), F.when(k % 3 == 1, b + 1).otherwise(F.lit(None)).alias("last"),
                                               F.when((k % 3 == 2) & (b > 0), b).alias("bid"), (b + 4).alias("ask"))
    rows = rows.withColumn("last", F.when(F.col("last") > 1, F.col("last")))
    return rows.withColumn("ask", F.when(F.col("c_custkey") % 3 == 2, F.col("ask"))).select("c_custkey", M.mark_price().alias("mark"))


# --- events and decisions -------------------------------------------------------------

EVENTS = f"""ev0 AS (SELECT *, lag(sig) OVER (PARTITION BY {BY} ORDER BY i) AS ps FROM sg),
te AS MATERIALIZED (SELECT {BY}, t + 900000 AS candle_close_t, CASE WHEN coalesce(ps, 0) = 0 THEN 'FLAT' WHEN ps = 1 THEN 'LONG' ELSE 'SHORT' END || '→' || CASE WHEN sig = 1 THEN 'LONG' ELSE 'SHORT' END AS transition,
  CASE WHEN sig = 1 THEN 'LONG' ELSE 'SHORT' END AS side, coalesce(ps, 0) AS state_before, sig AS state_after,
  'sig_' || sha256('{{"candle_close_t":' || (t + 900000) || ',"strategy_id":"' || strategy_id || '","symbol":"' || symbol || '","timeframe":"' || timeframe || '","transition":"' || (CASE WHEN coalesce(ps, 0) = 0 THEN 'FLAT' WHEN ps = 1 THEN 'LONG' ELSE 'SHORT' END || '→' || CASE WHEN sig = 1 THEN 'LONG' ELSE 'SHORT' END) || '"}}')[1:32] AS event_id
  FROM ev0 WHERE sig <> coalesce(ps, 0))"""
EV = f"WITH {walk()}, {signal_cte()}, {EVENTS}"


def event_table(spark, sf):
    return D.transitions(signal_table(spark, sf))


@check("transition_events", f"{EV} SELECT event_id, {BY}, candle_close_t, transition, side, state_before, state_after FROM te")
def _events(spark, sf):
    return event_table(spark, sf)


@check("signal_snapshot", f"""{EV}, mv AS (SELECT {BY}, max(candle_close_t) - 900000 AS mt, arg_max(state_after, candle_close_t) AS position FROM te GROUP BY 1, 2, 3), rw AS (SELECT {BY}, max(t) AS rt FROM sg GROUP BY 1, 2, 3),
en AS (SELECT symbol, max(t) AS last_t FROM bars GROUP BY 1) SELECT {BY}, position, CASE position WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, (last_t - rt) // 900000 AS raw_age, (last_t - mt) // 900000 AS transition_age, last_t = mt AS fresh, last_t
  FROM mv JOIN rw USING ({BY}) JOIN en USING (symbol)""")
def _snapshot(spark, sf):
    return D.signal_snapshot(signal_table(spark, sf), T.last_bars(bars(spark, sf)).drop("last_c"))


ARM_T, ARM_NOW = 1_705_276_800_000, 1_706_572_800_000
ARMED = f"""ar AS MATERIALIZED (SELECT *, CASE WHEN candle_close_t <= {ARM_T} THEN 'SUPPRESSED' WHEN {ARM_NOW} - candle_close_t > 900000 THEN 'MISSED' ELSE 'ELIGIBLE' END AS arming,
  CASE WHEN candle_close_t <= {ARM_T} THEN 'PRE_ARMING' WHEN {ARM_NOW} - candle_close_t > 900000 THEN 'DOWNTIME' END AS arming_reason FROM te)"""


@check("arming_status", f"{EV}, {ARMED} SELECT event_id, arming, arming_reason FROM ar")
def _arming(spark, sf):
    return D.arming_status(event_table(spark, sf), "ARMED", ARM_T, ARM_NOW).select("event_id", "arming", "arming_reason")


@check("event_freshness", f"{EV} SELECT event_id, CASE WHEN greatest(0, {ARM_NOW} - candle_close_t) > 900000 THEN 'MISSED' ELSE 'FRESH' END AS freshness, greatest(0, {ARM_NOW} - candle_close_t) AS age_ms FROM te")
def _fresh(spark, sf):
    return D.freshness(event_table(spark, sf), ARM_NOW).select("event_id", "freshness", "age_ms")


# Market snapshots: every seventh tick of a symbol describes its market.
SNAPS = """sp AS MATERIALIZED (SELECT event_type AS symbol, max(epoch_us(ts) // 1000) AS snapshot_t, max(value / 10) AS spread, max(value * 3) AS bd, max(value * 2 + user_id) AS ad, max(value * 4000) AS vol, max(value * 3000) AS oi,
  max(CASE WHEN event_id % 23 = 0 THEN 'BREAK' ELSE 'TRADING' END) AS symbol_status FROM events WHERE true GROUP BY event_type, epoch_us(ts) // 300000000)"""


def snapshots(spark, sf):
    e = table(spark, sf, "events")
    v, t = F.col("value"), ms("ts")
    rows = e.groupBy(F.col("event_type").alias("symbol"), F.floor(t / 300_000).alias("_b")).agg(
        F.max(t).alias("snapshot_t"), F.max(v / 10).alias("spreadBps"), F.max(v * 3).alias("bidDepth10bps"), F.max(v * 2 + F.col("user_id")).alias("askDepth10bps"),
        F.max(v * 4000).alias("quoteVolume24h"), F.max(v * 3000).alias("openInterestNotional"), F.max(F.when(F.col("event_id") % 23 == 0, "BREAK").otherwise("TRADING")).alias("symbolStatus"))
    return rows.drop("_b")


AS_OF = """ao AS MATERIALIZED (SELECT a.*, s.snapshot_t, s.spread, s.bd, s.ad, s.vol, s.oi, s.symbol_status FROM ar a ASOF LEFT JOIN sp s ON s.symbol = a.symbol AND s.snapshot_t <= a.candle_close_t)"""
GATED = f"""g0 AS (SELECT *, coalesce(CASE WHEN side = 'LONG' THEN ad ELSE bd END, 0) AS entry_depth, coalesce(CASE WHEN side = 'LONG' THEN bd ELSE ad END, 0) AS exit_depth FROM ao),
gt AS MATERIALIZED (SELECT *, CASE WHEN early THEN 'SUPPRESSED' WHEN snapshot_t IS NULL OR candle_close_t - snapshot_t > 900000 THEN 'DEFER' WHEN symbol_status <> 'TRADING' OR coalesce(spread, 1e9) > 25 OR entry_depth < 250 OR exit_depth / 1.5 < 5 THEN 'REJECT' ELSE 'ALLOW' END AS verdict,
  CASE WHEN early THEN 'PRE_ARMING' WHEN snapshot_t IS NULL THEN 'INFRA_NO_MARKET_SNAPSHOT' WHEN candle_close_t - snapshot_t > 900000 THEN 'INFRA_STALE_MARKET_SNAPSHOT' WHEN symbol_status <> 'TRADING' THEN 'SYMBOL_NOT_TRADING' WHEN coalesce(spread, 1e9) > 25 THEN 'SPREAD_HARD'
    WHEN entry_depth < 250 THEN 'ENTRY_DEPTH_HARD' WHEN exit_depth / 1.5 < 5 THEN 'SIZE_BELOW_MIN' END AS reason FROM (SELECT *, candle_close_t <= {ARM_T} AS early FROM g0)),
gd AS MATERIALIZED (SELECT *, CASE WHEN verdict = 'ALLOW' THEN least(100.0, exit_depth / 1.5) END AS max_notional, CASE WHEN verdict = 'ALLOW' THEN concat_ws(',', CASE WHEN exit_depth < 200 THEN 'EXIT_LIQUIDITY_WARNING' END,
  CASE WHEN vol < 500000 THEN 'COHORT_VOLUME_WARNING' END, CASE WHEN oi < 500000 THEN 'COHORT_OI_WARNING' END) ELSE '' END AS warnings FROM gt)"""
POLICY = {**D.GATE, "max_age": 900_000}


def decided(spark, sf):
    # Every event after the arming point is judged on its own close.
    ev = event_table(spark, sf).withColumns({
        "arming": F.when(F.col("candle_close_t") <= ARM_T, "SUPPRESSED").otherwise("ELIGIBLE"), "arming_reason": F.when(F.col("candle_close_t") <= ARM_T, "PRE_ARMING")})
    placed = D.latest_snapshot(ev, snapshots(spark, sf), "candle_close_t")
    return D.execution_gate(placed, F.col("candle_close_t"), F.lit(100.0), POLICY)


@check("latest_snapshots", f"{EV}, {ARMED}, {SNAPS}, {AS_OF} SELECT event_id, snapshot_t, {r6('spread')} AS spread FROM ao")
def _as_of(spark, sf):
    return D.latest_snapshot(event_table(spark, sf), snapshots(spark, sf), "candle_close_t").select(
        "event_id", F.col("snap.snapshot_t").alias("snapshot_t"), F.col("snap.spreadBps").alias("spread"))


@check("execution_decisions", f"{EV}, {ARMED}, {SNAPS}, {AS_OF}, {GATED} SELECT event_id, verdict, reason, warnings, {r6('entry_depth')} AS entry_depth, {r6('exit_depth')} AS exit_depth, {r6('max_notional')} AS max_notional, snapshot_t FROM gd")
def _gate(spark, sf):
    return decided(spark, sf).select("event_id", "verdict", "reason", "warnings", "entry_depth", "exit_depth", "max_notional", "snapshot_t")


@check("decision_ids", f"""{EV}, {ARMED}, {SNAPS}, {AS_OF}, {GATED} SELECT event_id, 'dec_' || sha256('{{"event_id":"' || event_id || '","policy_version":"exec-v1","reason":' || coalesce('"' || reason || '"', 'null') || ',"snapshot_t":'
  || coalesce(CAST(snapshot_t AS VARCHAR), 'null') || ',"verdict":"' || verdict || '"}}')[1:32] AS decision_id FROM gd""")
def _ids(spark, sf):
    return decided(spark, sf).select("event_id", "decision_id")


ARB = f"""{GATED}, op AS (SELECT event_type AS symbol, CASE WHEN min(event_id) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS oside FROM events WHERE event_type IN ('click', 'error') GROUP BY 1),
ga AS (SELECT symbol, candle_close_t, min(side) AS s0, max(side) AS s1, count(*) AS support, min(event_id) AS lead_id, least(100.0, min(max_notional)) AS notional FROM gd WHERE verdict = 'ALLOW' GROUP BY 1, 2),
ab AS MATERIALIZED (SELECT ga.*, CASE WHEN s0 <> s1 THEN 'DIRECTION_CONFLICT' WHEN oside = s0 THEN 'EXISTING_POSITION_SAME_SIDE' WHEN oside IS NOT NULL THEN 'REVERSE_REQUIRES_POSITION_MANAGER' ELSE 'CREATED' END AS status FROM ga LEFT JOIN op ON op.symbol = ga.symbol)"""


def outcomes(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type").isin("click", "error"))
    open_ = e.groupBy(F.col("event_type").alias("symbol")).agg(F.when(F.min("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("side"))
    # No ledger yet: an intent id of nothing.
    ledger = e.limit(0).select(F.col("event_type").alias("intent_id"))
    return D.arbitrate(decided(spark, sf), open_, ledger, 100.0)


@check("arbitrated_intents", f"{EV}, {ARMED}, {SNAPS}, {AS_OF}, {ARB} SELECT symbol, candle_close_t, status, support, lead_id, CASE WHEN status = 'CREATED' THEN s0 END AS side, CASE WHEN status = 'CREATED' THEN 'ENTER_' || s0 END AS action, CASE WHEN status = 'CREATED' THEN {r6('notional')} END AS notional FROM ab")
def _arbitrate(spark, sf):
    return outcomes(spark, sf).select("symbol", "candle_close_t", "status", "support", "lead_id", "side", "action", "notional")


@check("simple_arbiter", f"""WITH {walk()}, {signal_cte()}, {CURRENT}, x AS (SELECT symbol, timeframe, CASE WHEN li - si < 40 THEN state END AS d FROM ls JOIN en USING (symbol, timeframe))
SELECT symbol, timeframe, CASE WHEN count(d) = 0 OR min(d) <> max(d) THEN 'NO_TRADE' WHEN min(d) = 1 THEN 'LONG' ELSE 'SHORT' END AS decision, count(d) AS support,
  CASE WHEN count(d) = 0 THEN 'NO_FRESH_SIGNAL' WHEN min(d) <> max(d) THEN 'DIRECTION_CONFLICT' ELSE 'AGGREGATED' END AS reason FROM x GROUP BY 1, 2""")
def _simple(spark, sf):
    now = M.current_signals(bars(spark, sf), IDS, bound(spark, sf)).withColumn("fresh", F.col("age") < 40)
    return D.simple_arbiter(now, ["symbol", "timeframe"])


def _census(spark, sf):
    d = decided(spark, sf)
    n = lambda v: F.count_if(F.col("verdict") == v)
    a = d.groupBy("symbol").agg(F.count("*").alias("transition_events"), n("ALLOW").alias("execution_allow"), n("DEFER").alias("execution_defer"), n("REJECT").alias("execution_reject"),
                                n("SUPPRESSED").alias("execution_suppressed"), n("MISSED").alias("execution_missed"))
    o = outcomes(spark, sf).groupBy("symbol").agg(F.sum(F.when(F.col("status") == "CREATED", F.col("support")).otherwise(0)).alias("intents_created"),
                                                  F.sum(F.when(F.col("status") != "CREATED", F.col("support")).otherwise(0)).alias("arbiter_suppressed"))
    b = bars(spark, sf).groupBy("symbol").agg((F.count("*") * len(IDS)).alias("evaluated"))
    return (b.join(a, "symbol").join(o, "symbol", "left").na.fill(0).withColumns({
        "expected_evaluations": F.col("evaluated"), "not_evaluated": F.lit(0), "no_transition": F.col("evaluated") - F.col("transition_events") - F.when(F.col("symbol") == "view", 1).otherwise(0),
        "intent_open": F.col("intents_created")}))


@check("census_violations", """SELECT 'view' AS symbol, 'EVALUATION_TO_TRANSITION_CONSERVATION' AS name, n AS "left", n - 1 AS "right", 1 AS delta FROM (
  SELECT count(DISTINCT epoch_us(ts) // 900000000) * 4 AS n FROM events WHERE event_type = 'view')""")
def _census_check(spark, sf):
    return D.census_checks(_census(spark, sf), ["symbol"])


CURSORS = f"""cu AS (SELECT {BY}, CASE WHEN strategy_id = 'vis_sr_breaks' THEN NULL ELSE min(candle_close_t) + 86400000 END AS lo, max(candle_close_t) - 86400000 AS hi FROM te GROUP BY 1, 2, 3)"""


@check("events_since_cursor", f"{EV}, {CURSORS} SELECT event_id, candle_close_t FROM te JOIN cu USING ({BY}) WHERE candle_close_t > lo AND candle_close_t <= hi")
def _since(spark, sf):
    ev = event_table(spark, sf)
    cur = ev.groupBy(*KEYS).agg((F.min("candle_close_t") + 86_400_000).alias("last_close_t"), (F.max("candle_close_t") - 86_400_000).alias("latest_close_t"))
    return D.events_since(ev, cur.withColumn("last_close_t", F.when(F.col("strategy_id") != "vis_sr_breaks", F.col("last_close_t")))).select("event_id", "candle_close_t")


# One cycle per order date.
CYC = """cy AS (SELECT o_orderdate AS d, count(*) AS transitions, count(*) FILTER (o_orderstatus = 'O') AS allow, count(*) FILTER (o_orderstatus = 'F') AS reject, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS defer,
  list_sort(list(DISTINCT o_orderstatus)) AS coverage, min(o_orderkey) % 9 = 0 AS off FROM orders GROUP BY 1)"""


def cycles(spark, sf):
    s = F.col("o_orderstatus")
    c = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("d")).agg(
        F.count("*").alias("transitions"), F.count_if(s == "O").alias("allow"), F.count_if(s == "F").alias("reject"), F.count_if(~s.isin("O", "F")).alias("defer"),
        F.collect_set(s).alias("coverage"), (F.min("o_orderkey") % 9 == 0).alias("off"))
    return c.withColumns({"expected": F.lit(10), "evaluated": F.when(F.col("off"), 8).otherwise(9), "not_evaluated": F.lit(1), "suppressed": F.lit(0), "missed": F.lit(0),
                          "intents_created": F.col("allow"), "arbiter_suppressed": F.when(F.col("off"), 1).otherwise(0)})


@check("evidence_totals", f"""WITH {CYC} SELECT count(*) AS cycles, CAST(sum(transitions) AS BIGINT) AS transitions, CAST(sum(allow) AS BIGINT) AS allow, CAST(sum(reject) AS BIGINT) AS reject,
  (SELECT array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') FROM orders) AS coverage FROM cy""")
def _totals(spark, sf):
    return D.evidence_totals(cycles(spark, sf), ["transitions", "allow", "reject"])


@check("cycle_checks", f"WITH {CYC} SELECT epoch_ms(d) AS d, CASE WHEN off THEN 'EVALUATION_CONSERVATION,ALLOW_ARBITER_CONSERVATION' ELSE '' END AS errors FROM cy")
def _cycle_checks(spark, sf):
    return D.cycle_checks(cycles(spark, sf)).select(ms("d").alias("d"), "errors")


@check("recent_unique_events", f"""{EV}, dup AS (SELECT event_id, candle_close_t AS seen_t, side FROM te UNION ALL SELECT event_id, candle_close_t + 5, 'LATE' FROM te), k AS (SELECT event_id, min(seen_t) AS seen_t, arg_min(side, seen_t) AS side FROM dup GROUP BY 1)
SELECT event_id, seen_t, side FROM k ORDER BY seen_t DESC, event_id DESC LIMIT 500""")
def _recent_events(spark, sf):
    ev = event_table(spark, sf).select("event_id", F.col("candle_close_t").alias("seen_t"), "side")
    return D.recent_unique(ev.unionByName(ev.withColumns({"seen_t": F.col("seen_t") + 5, "side": F.lit("LATE")})))


LATE_NOW = 1_706_486_400_000
LATE = f"""{ARB}, strm AS (SELECT DISTINCT symbol AS underlying, symbol, timeframe, strategy_id FROM te), lastd AS (SELECT {BY}, arg_max(side, candle_close_t) AS direction FROM te WHERE candle_close_t <= {LATE_NOW} GROUP BY 1, 2, 3),
rc AS (SELECT symbol AS underlying, symbol, timeframe, strategy_id, event_id, candle_close_t, side, verdict FROM gd WHERE candle_close_t <= {LATE_NOW} AND {LATE_NOW} - candle_close_t <= 900000 AND verdict = 'ALLOW'),
lt AS (SELECT rc.symbol, rc.timeframe, rc.strategy_id, arg_max(event_id, candle_close_t) AS ev, arg_max(rc.side, candle_close_t) AS ev_side FROM rc JOIN lastd USING ({BY}) WHERE rc.side = direction GROUP BY 1, 2, 3)"""


def stream_rows(spark, sf):
    d = decided(spark, sf).where(F.col("candle_close_t") <= LATE_NOW).withColumn("underlying", F.col("symbol"))
    rows = d.groupBy("underlying", *KEYS).agg(F.max_by("side", "candle_close_t").alias("direction")).withColumns(
        {"event_id": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "side": F.lit(None).cast("string")})
    return D.catchup_actions(rows, d, LATE_NOW)


@check("catchup_actions", f"{EV}, {ARMED}, {SNAPS}, {AS_OF}, {LATE} SELECT {BY}, direction, lt.ev AS late_id FROM lastd LEFT JOIN lt USING ({BY})")
def _late(spark, sf):
    return stream_rows(spark, sf).select(*KEYS, "direction", F.col("late.event_id").alias("late_id"))


@check("row_statuses", f"""{EV}, {ARMED}, {SNAPS}, {AS_OF}, {LATE}, lk AS (SELECT event_id, ab.lead_id FROM gd JOIN ab ON ab.symbol = gd.symbol AND ab.candle_close_t = gd.candle_close_t AND ab.status = 'CREATED' WHERE verdict = 'ALLOW')
SELECT {BY}, CASE WHEN lt.ev IS NULL THEN 'ACTIVE_TREND' WHEN lead_id IS NULL THEN 'ARBITER_SUPPRESSED' WHEN lead_id = lt.ev THEN 'FRESH_ENTRY' ELSE 'SUPPORTING_SIGNAL' END AS status,
  CASE WHEN lead_id = lt.ev THEN 'ENTER_' ELSE 'HOLD_' END || coalesce(ev_side, direction) AS action, coalesce(lead_id = lt.ev, false) AS fresh FROM lastd LEFT JOIN lt USING ({BY}) LEFT JOIN lk ON lk.event_id = lt.ev""")
def _row_status(spark, sf):
    made = outcomes(spark, sf).where("status = 'CREATED'").select("lead_id", "signal_ids", "intent_id")
    return D.row_status(stream_rows(spark, sf), made).select(*KEYS, "status", "action", "fresh")


@check("row_actions", f"""WITH {ROWS} SELECT k, CASE WHEN age = 0 AND status = 'FRESH_ENTRY' AND NOT direction_conflict AND direction <> 'FLAT' THEN 'ENTER' WHEN age = 0 AND direction = 'FLAT' THEN 'EXIT_FLAT' ELSE 'NONE' END AS kind,
  coalesce(CASE WHEN age = 0 AND NOT direction_conflict AND direction <> 'FLAT' THEN entry_t + CASE timeframe WHEN '5m' THEN 300000 WHEN '15m' THEN 900000 WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 END END, -1) AS expires_t FROM ws""")
def _row_actions(spark, sf):
    rows = watch_rows(spark, sf).withColumns({"fresh": F.col("age") == 0, "action": F.when(F.col("direction") == "FLAT", "EXIT_TO_FLAT").otherwise("ENTER")})
    return D.row_action(rows).select("k", "kind", F.coalesce("expires_t", F.lit(-1)).alias("expires_t"))


@check("pending_entries", f"WITH {ROWS}, k AS (SELECT underlying, max(entry_t * 100000 + k) AS m, arg_max(k, entry_t * 100000 + k) AS k, arg_max(entry_t, entry_t * 100000 + k) AS entry_t FROM ws GROUP BY 1) SELECT underlying, k, entry_t + 3600000 AS expires_t FROM k WHERE entry_t + 3600000 > 990000000000")
def _pending(spark, sf):
    log = watch_rows(spark, sf).select("underlying", (F.col("entry_t") * 100000 + F.col("k")).alias("entry_t"), "k", (F.col("entry_t") + 3_600_000).alias("expires_t"))
    return D.pending_entries(log, 990_000_000_000).drop("entry_t")


# --- ledgers -------------------------------------------------------------------------------

FILLS = """fl AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS fill_id, 'S' || max(l_suppkey) AS symbol, CASE WHEN max(l_returnflag) = 'R' THEN 'SELL' ELSE 'BUY' END AS side, max(l_quantity) AS qty, floor(max(l_extendedprice)) AS price,
  max(epoch_ms(l_shipdate)) AS event_time, l_orderkey AS intent_id FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def fills(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.concat(F.lit("S"), F.max("l_suppkey").cast("string")).alias("symbol"), F.when(F.max("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.max("l_quantity").alias("quantity"),
        F.floor(F.max("l_extendedprice")).cast("double").alias("fill_price"), F.max(ms("l_shipdate")).alias("event_time"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fill_id"), "symbol", "side", "quantity", "fill_price", "event_time", F.col("l_orderkey").alias("intent_id"))


LEDGER = f"""{FILLS}, sq AS MATERIALIZED (SELECT *, CASE side WHEN 'BUY' THEN qty ELSE -qty END AS q, row_number() OVER (PARTITION BY symbol ORDER BY event_time, fill_id) - 1 AS i FROM fl),
lr AS (SELECT symbol, i, q AS pos, price AS av, CAST(0 AS DOUBLE) AS gain FROM sq WHERE i = 0 UNION ALL
  SELECT x.symbol, x.i, CASE WHEN abs(r.pos + x.q) < 1e-12 THEN 0 ELSE r.pos + x.q END,
    CASE WHEN abs(r.pos) < 1e-12 OR sign(r.pos) = sign(x.q) THEN (r.av * abs(r.pos) + x.price * abs(x.q)) / (abs(r.pos) + abs(x.q)) WHEN abs(r.pos + x.q) < 1e-12 THEN 0 WHEN sign(r.pos + x.q) <> sign(r.pos) THEN x.price ELSE r.av END,
    CASE WHEN abs(r.pos) < 1e-12 OR sign(r.pos) = sign(x.q) THEN 0 WHEN r.pos > 0 THEN (x.price - r.av) * least(abs(r.pos), abs(x.q)) ELSE (r.av - x.price) * least(abs(r.pos), abs(x.q)) END
  FROM lr r JOIN sq x ON x.symbol = r.symbol AND x.i = r.i + 1)"""


@check("position_ledger", f"WITH RECURSIVE {LEDGER} SELECT fill_id, s.symbol, {r6('gain')} AS realised, {r6('pos')} AS position, {r6('av')} AS avg_cost FROM lr JOIN sq s ON s.symbol = lr.symbol AND s.i = lr.i")
def _ledger(spark, sf):
    f = fills(spark, sf)
    rows = f.select("fill_id", "symbol", F.col("event_time").alias("t"),
                    F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("qty"), F.col("fill_price").alias("price"))
    # Halves at the sixth place are rounded in doubles, as the SQL's round does, not by their decimal form.
    six = [(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in ("realised", "position", "avg_cost")]
    return T.position_ledger(rows, tie="fill_id").select("fill_id", "symbol", *six)


@check("net_positions", f"""WITH {FILLS}, a AS (SELECT symbol, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS x FROM fl GROUP BY 1), b AS (SELECT 'S' || s_suppkey AS symbol, sum(floor(s_acctbal)) AS y FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT coalesce(a.symbol, b.symbol) AS symbol, {r6('coalesce(x, 0)')} AS from_fills, {r6('coalesce(y, 0)')} AS from_adjustments, {r6('coalesce(x, 0) + coalesce(y, 0)')} AS net FROM a FULL JOIN b ON a.symbol = b.symbol""")
def _net(spark, sf):
    return T.net_position(fills(spark, sf), adjustments(spark, sf))


def adjustments(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.floor("s_acctbal").cast("double").alias("quantity_delta"))


@check("implementation_shortfall", f"""WITH {FILLS} SELECT fill_id, {r6("CASE WHEN floor(o_totalprice) - 150000 > 0 THEN (CASE side WHEN 'BUY' THEN 1 ELSE -1 END) * (price - (floor(o_totalprice) - 150000)) / (floor(o_totalprice) - 150000) * 10000 END")} AS shortfall_bps
FROM fl LEFT JOIN orders ON o_orderkey = intent_id""")
def _shortfall(spark, sf):
    f = fills(spark, sf)
    twice = f.unionByName(f.where("fill_id % 3 = 0").withColumn("event_time", F.col("event_time") + 1))
    intents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("intent_id"), (F.floor("o_totalprice") - 150_000).cast("double").alias("expected_price"))
    return T.implementation_shortfall(twice, intents).select("fill_id", "shortfall_bps")


# Lineage records: line items with missing links here and there.
RECS = """rc AS MATERIALIZED (SELECT k AS seq, 'F' || (k % 9000) AS fill_id, 'S' || (k % 90) AS symbol, CASE WHEN k % 101 = 0 THEN NULL ELSE 'e' || k % 9000 END AS event_id, CASE WHEN k % 2 = 0 THEN 'ALLOW' ELSE 'DEFER' END AS verdict,
  CASE WHEN k % 103 = 0 THEN NULL ELSE 'd' || k % 9000 END AS decision_id, CASE WHEN k % 107 = 0 THEN NULL ELSE 'i' || k % 9000 END AS intent_id, CASE WHEN k % 109 = 0 THEN NULL ELSE 'c' || k % 9000 END AS client_order_id,
  CASE WHEN k % 113 = 0 THEN NULL ELSE 'x' || k % 9000 END AS order_id, CASE WHEN k > 9000 AND k % 7 = 0 THEN 2.0 ELSE 1.0 END AS qty FROM (SELECT o_orderkey AS k FROM orders))"""
R_ERR = """concat_ws(',', CASE WHEN event_id IS NULL THEN 'MISSING_SIGNAL_EVENT_ID' END, CASE WHEN verdict = 'ALLOW' AND decision_id IS NULL THEN 'MISSING_EXECUTION_DECISION_ID' END, CASE WHEN verdict = 'ALLOW' AND intent_id IS NULL THEN 'MISSING_INTENT_ID' END,
  CASE WHEN intent_id IS NOT NULL AND client_order_id IS NULL THEN 'MISSING_CLIENT_ORDER_ID' END, CASE WHEN order_id IS NULL THEN 'FILL_MISSING_EXCHANGE_ORDER_ID' END, CASE WHEN event_id IS NULL THEN 'ORPHAN_FILL' END)"""


def records(spark, sf):
    k = F.col("o_orderkey")
    link = lambda tag, n: F.when(k % n != 0, F.concat(F.lit(tag), (k % 9000).cast("string")))
    return table(spark, sf, "orders").select(
        k.alias("seq"), F.concat(F.lit("F"), (k % 9000).cast("string")).alias("fill_id"), F.concat(F.lit("S"), (k % 90).cast("string")).alias("symbol"), link("e", 101).alias("event_id"),
        F.when(k % 2 == 0, "ALLOW").otherwise("DEFER").alias("verdict"), link("d", 103).alias("decision_id"), link("i", 107).alias("intent_id"), link("c", 109).alias("client_order_id"),
        link("x", 113).alias("order_id"), F.when((k > 9000) & (k % 7 == 0), 2.0).otherwise(1.0).alias("qty"))


@check("lineage_errors", f"WITH {RECS} SELECT seq, {R_ERR} AS errors FROM rc")
def _lineage(spark, sf):
    return D.lineage(records(spark, sf)).select("seq", "errors")


@check("fill_ledger", f"""WITH {RECS}, e AS (SELECT *, {R_ERR} AS er, concat_ws('|', symbol, verdict, coalesce(decision_id, '-'), coalesce(intent_id, '-'), coalesce(client_order_id, '-'), event_id, order_id, qty) AS body FROM rc),
f AS (SELECT fill_id, min(seq) AS s, arg_min(body, seq) AS b FROM e WHERE er = '' GROUP BY 1) SELECT seq, CASE WHEN er <> '' THEN 'ORPHAN_FILL' WHEN seq = s THEN 'RECORDED' WHEN body = b THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status FROM e LEFT JOIN f USING (fill_id)""")
def _fill_ledger(spark, sf):
    return D.fill_ledger(records(spark, sf)).select("seq", "status")


@check("halted_symbols", f"WITH {RECS} SELECT DISTINCT symbol FROM rc WHERE {R_ERR} <> ''")
def _halted(spark, sf):
    return D.halted_symbols(D.fill_ledger(records(spark, sf)))


@check("journal_chain", """WITH c AS (SELECT o_custkey AS stream, o_orderkey AS seq, 'h' || coalesce(lag(o_orderkey) OVER w, 0) + CASE WHEN o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS fh, 'h' || o_orderkey AS th FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
d AS (SELECT *, lag(th) OVER (PARTITION BY stream ORDER BY seq) AS head FROM c) SELECT stream, seq, head IS NULL OR head = fh AS ok FROM d""")
def _chain(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    before = F.coalesce(F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.lit(0)) + F.when(k % 61 == 0, 1).otherwise(0)
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("stream"), k.alias("seq"), F.concat(F.lit("k"), k.cast("string")).alias("commit_id"),
                                          F.concat(F.lit("h"), before.cast("string")).alias("from_hash"), F.concat(F.lit("h"), k.cast("string")).alias("to_hash"))
    again = c.where("seq % 5 = 0").withColumn("seq", F.col("seq") + 1_000_000)
    return D.journal_chain(c.unionByName(again)).select("stream", "seq", "ok")


@check("path_parity", f"{EV} SELECT event_id, CASE WHEN candle_close_t % 7 = 0 THEN 'ONLY_LEFT' WHEN candle_close_t % 5400000 = 0 THEN 'DIFFERENT' ELSE 'EQUAL' END AS parity FROM te")
def _path(spark, sf):
    ev = event_table(spark, sf)
    t = F.col("candle_close_t")
    other = ev.where(t % 7 != 0).withColumn("side", F.when(t % 5_400_000 == 0, "X").otherwise(F.col("side")))
    return D.path_parity(ev, other, ["candle_close_t", "side", "transition"]).select("event_id", "parity")


@check("readiness", """WITH e AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list(DISTINCT CASE o_orderstatus WHEN 'O' THEN 'ALLOW' WHEN 'F' THEN 'REJECT' ELSE 'DEFER' END)) AS cov, o_custkey % 2 = 0 AS ci, o_custkey % 5 AS orphan FROM orders GROUP BY 1),
r AS (SELECT k, n, concat_ws(',', CASE WHEN NOT ci THEN 'CI_NOT_GREEN' END, CASE WHEN orphan <> 0 THEN 'ORPHAN_FILL_PRESENT' END, CASE WHEN n < 8 THEN 'INSUFFICIENT_COMPARABLE_DECISIONS' END,
  CASE WHEN NOT list_contains(cov, 'ALLOW') THEN 'MISSING_DECISION_COVERAGE_ALLOW' END, CASE WHEN NOT list_contains(cov, 'REJECT') THEN 'MISSING_DECISION_COVERAGE_REJECT' END) AS reasons FROM e)
SELECT k, reasons, CASE WHEN reasons = '' THEN 'READY_FOR_MANUAL_REVIEW' ELSE 'SHADOW_ONLY' END AS status, false AS can_enable_execution FROM r""")
def _readiness(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("k")
    e = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count("*").alias("comparable"), F.collect_set(F.when(s == "O", "ALLOW").when(s == "F", "REJECT").otherwise("DEFER")).alias("coverage"))
    yes = F.lit(True)
    e = e.withColumns({"ci_green": k % 2 == 0, "restart_parity": yes, "event_parity": yes, "census_clean": yes, "rollback_rehearsed": yes, "orphan_fills": k % 5, "unexplained": F.lit(0)})
    return D.readiness(e, ["ALLOW", "REJECT"], 8).select("k", "reasons", "status", "can_enable_execution")


@check("position_actions", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'NO_POSITION' WHEN o_orderkey % 6 = 1 THEN 'CLOSE' WHEN o_orderkey % 3 = 2 THEN 'HALT_AND_PROTECT' ELSE 'HOLD_PROTECTED' END AS action,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'STRATEGY_EXIT' WHEN o_orderkey % 3 = 2 THEN 'OPEN_POSITION_UNPROTECTED' WHEN o_orderstatus = 'F' THEN 'ENTRY_GATE_NOT_EXIT_AUTHORITY' END AS action_reason FROM orders""")
def _position(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("k"), (k % 4 != 0).alias("is_open"), (k % 3 != 2).alias("is_protected"), F.when(k % 6 == 1, "STRATEGY_EXIT").when(k % 6 == 2, "OTHER").alias("close_authority"),
                                             F.when(F.col("o_orderstatus") == "F", "REJECT").otherwise("ALLOW").alias("verdict"))
    return D.position_action(rows).select("k", "action", "action_reason")


@check("risk_screen", """WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN 'HALTED' ELSE 'RUNNING' END AS mode, floor(o_totalprice) AS e, CAST(o_orderkey % 500 AS DOUBLE) * 100 AS r FROM orders)
SELECT k, concat_ws(',', CASE WHEN mode <> 'RUNNING' THEN 'SYSTEM_NOT_RUNNING' END, CASE WHEN NOT e > 0 THEN 'INVALID_EQUITY' END, CASE WHEN NOT r > 0 THEN 'INVALID_NOTIONAL' END, CASE WHEN 1000 + r > e * 0.1 THEN 'SYMBOL_NOTIONAL_LIMIT' END,
  CASE WHEN 5000 + r > e * 0.5 THEN 'PORTFOLIO_NOTIONAL_LIMIT' END, CASE WHEN (5000 + r) / e > 0.75 THEN 'EFFECTIVE_LEVERAGE_LIMIT' END, CASE WHEN k % 7 >= 5 THEN 'MAX_OPEN_POSITIONS' END, CASE WHEN e <= 100000 * 0.5 THEN 'DAILY_LOSS_BREAKER' END,
  CASE WHEN e <= 120000 * 0.5 THEN 'WEEKLY_LOSS_BREAKER' END, CASE WHEN e <= 200000 * 0.25 THEN 'DRAWDOWN_BREAKER' END) AS reasons FROM q""")
def _risk(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 29 == 0, "HALTED").otherwise("RUNNING").alias("mode"), F.floor("o_totalprice").cast("double").alias("equity"), ((k % 500).cast("double") * 100).alias("requested"),
        F.lit(1000.0).alias("symbol_notional"), F.lit(5000.0).alias("portfolio_notional"), (k % 7).alias("open_positions"), F.lit(100000.0).alias("day_start"), F.lit(120000.0).alias("week_start"), F.lit(200000.0).alias("peak"))
    limits = {"symbol_pct": 0.1, "portfolio_pct": 0.5, "leverage": 0.75, "positions": 5, "daily_pct": 0.5, "weekly_pct": 0.5, "drawdown_pct": 0.75}
    return D.risk_screen(rows, limits).select("k", "reasons")


@check("position_reconciliation", f"""WITH {FILLS}, ex AS (SELECT symbol, sum(CASE side WHEN 'BUY' THEN qty ELSE -qty END) AS x FROM fl GROUP BY 1), ac AS (SELECT 'S' || s_suppkey AS symbol, x + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS y FROM supplier JOIN ex ON ex.symbol = 'S' || s_suppkey),
od AS (SELECT 'S' || (o_custkey % 100) AS symbol, count(*) AS n FROM orders WHERE o_orderkey % 50 = 3 GROUP BY 1)
SELECT coalesce(ex.symbol, od.symbol) AS symbol, {r6('coalesce(x, 0)')} AS expected, {r6('coalesce(y, 0)')} AS actual, coalesce(n, 0) AS foreign_orders, abs(coalesce(y, 0) - coalesce(x, 0)) > 1e-9 AS mismatch,
  abs(coalesce(y, 0) - coalesce(x, 0)) > 1e-9 OR coalesce(n, 0) > 0 AS halt FROM ex JOIN ac USING (symbol) FULL JOIN od ON od.symbol = ex.symbol""")
def _reconcile(spark, sf):
    ex = fills(spark, sf).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("net"))
    shift = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.when(F.col("s_suppkey") % 9 == 0, 1.0).otherwise(0.0).alias("d"))
    actual = ex.join(shift, "symbol").select("symbol", (F.col("net") + F.col("d")).alias("position"))
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").where(k % 5 == 3).select(F.concat(F.lit("S"), (F.col("o_custkey") % 100).cast("string")).alias("symbol"), F.concat(F.lit("c"), k.cast("string")).alias("client_order_id"), k.alias("k"))
    return D.reconcile_positions(orders.drop("k"), orders.where("k % 50 <> 3").select("client_order_id"), ex, actual)


PAYLOAD = """CASE o_orderkey % 9 WHEN 0 THEN '{"e":"ORDER_TRADE_UPDATE","o":{"x":"TRADE","X":"FILLED"}}' WHEN 1 THEN '{"e":"ORDER_TRADE_UPDATE","o":{"x":"CALCULATED","X":"FILLED"}}' WHEN 2 THEN '{"e":"ACCOUNT_UPDATE","a":{"m":"FUNDING_FEE"}}' WHEN 3 THEN '{"e":"ACCOUNT_UPDATE","m":"ADL"}'
  WHEN 4 THEN '{"e":"ACCOUNT_UPDATE","a":{"m":"MARGIN_TRANSFER"}}' WHEN 5 THEN '{"e":"ACCOUNT_UPDATE","a":{"m":"ORDER"}}' WHEN 6 THEN '{"e":"ACCOUNT_UPDATE","a":{"m":"DEPOSIT"}}' WHEN 7 THEN '{"e":"MARGIN_CALL"}' ELSE '{"e":"other"}' END"""


@check("account_events", f"""SELECT o_orderkey AS k, CASE WHEN e = 'ORDER_TRADE_UPDATE' THEN CASE WHEN x = 'CALCULATED' THEN 'LIQUIDATION' ELSE 'ORDER' END WHEN e = 'ACCOUNT_UPDATE' THEN CASE m WHEN 'FUNDING_FEE' THEN 'FUNDING_FEE' WHEN 'ADL' THEN 'ADL' WHEN 'MARGIN_TRANSFER' THEN 'MARGIN_EVENT'
  WHEN 'ORDER' THEN 'ORDER' ELSE 'UNKNOWN' END WHEN e = 'MARGIN_CALL' THEN 'LIQUIDATION' ELSE 'UNKNOWN' END AS kind FROM (SELECT o_orderkey, p ->> '$.e' AS e, p ->> '$.o.x' AS x, coalesce(p ->> '$.a.m', p ->> '$.m') AS m FROM (SELECT o_orderkey, {PAYLOAD} AS p FROM orders))""")
def _account(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), D.classify_account_event(F.expr(PAYLOAD)).alias("kind"))


@check("flatness_proof", """WITH p AS (SELECT o_custkey AS symbol, o_orderkey AS n, o_orderkey % 31 <> 0 AS ok, CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 2.0 ELSE 0.0 END AS pos, CASE WHEN o_orderkey % 43 = 0 THEN 1 ELSE 0 END AS od FROM orders),
b AS (SELECT *, CASE WHEN NOT ok THEN 'RECONCILIATION_READ_FAILED' WHEN pos IS NULL THEN 'POSITION_NOT_NUMERIC' WHEN pos <> 0 THEN 'POSITION_REMAINS_OPEN' WHEN od > 0 THEN 'OPEN_ORDERS_REMAIN' END AS bad FROM p),
g AS (SELECT symbol, count(*) AS passes, arg_min(bad, n) FILTER (bad IS NOT NULL) AS why FROM b GROUP BY 1)
SELECT 'C' || symbol AS symbol, passes, CASE WHEN passes < 2 OR why IS NOT NULL THEN 'CRITICAL_UNRESOLVED' WHEN symbol % 4 = 0 THEN 'SKIPPED_UNAVAILABLE_VERIFIED_FLAT' ELSE 'FLAT' END AS status,
  CASE WHEN passes < 2 THEN 'INSUFFICIENT_RECONCILIATION_PASSES' WHEN why IS NOT NULL THEN why WHEN symbol % 4 = 0 THEN 'UNAVAILABLE_BUT_EXCHANGE_FLAT_PROVEN' ELSE 'EXCHANGE_FLAT_PROVEN' END AS reason FROM g""")
def _flat(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    p = table(spark, sf, "orders").select(name.alias("symbol"), k.alias("pass_no"), (k % 31 != 0).alias("ok"), F.when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, 2.0).otherwise(0.0).alias("position"),
                                          F.when(k % 43 == 0, 1).otherwise(0).alias("regular_orders"), F.lit(0).alias("algo_orders"))
    gone = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    return D.flatness_proof(p, gone)


@check("order_rule_screen", """WITH q AS (SELECT o_orderkey AS k, o_custkey % 120 AS s, floor(o_totalprice) / 64 AS price, CAST(o_orderkey % 40 AS DOUBLE) / 8 AS qty FROM orders), r AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 11 = 0 THEN 'BREAK' ELSE 'TRADING' END AS status FROM supplier),
f AS (SELECT k, status, CASE WHEN status IS NULL THEN price ELSE floor((price + 2.220446049250313e-16) / 0.5) * 0.5 END AS p, CASE WHEN status IS NULL THEN qty ELSE floor((qty + 2.220446049250313e-16) / 0.25) * 0.25 END AS q FROM q LEFT JOIN r USING (s))
SELECT k, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q, CASE WHEN status IS NULL THEN 'SYMBOL_NOT_FOUND' WHEN status <> 'TRADING' THEN 'SYMBOL_NOT_TRADING' WHEN NOT (p > 0 AND q > 0) THEN 'INVALID_NORMALIZED_ORDER' WHEN p < 300 THEN 'PRICE_BELOW_MIN' WHEN p > 7000 THEN 'PRICE_ABOVE_MAX'
  WHEN p > 3000 * 2 THEN 'PRICE_ABOVE_PERCENT_BAND' WHEN p < 3000 * 0.25 THEN 'PRICE_BELOW_PERCENT_BAND' WHEN q < 0.5 THEN 'QTY_BELOW_MIN' WHEN q > 4.5 THEN 'QTY_ABOVE_MAX' WHEN p * q < 1500 THEN 'NOTIONAL_BELOW_MIN' END AS reject_reason FROM f""")
def _rules(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k.alias("k"), (F.col("o_custkey") % 120).alias("symbol"), (F.floor("o_totalprice") / 64).alias("price"), ((k % 40).cast("double") / 8).alias("quantity"), F.lit(3000.0).alias("reference_price"))
    lits = dict(tickSize=0.5, stepSize=0.25, minPrice=300.0, maxPrice=7000.0, multiplierUp=2.0, multiplierDown=0.25, minQty=0.5, maxQty=4.5, minNotional=1500.0)
    rules = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.when(F.col("s_suppkey") % 11 == 0, "BREAK").otherwise("TRADING").alias("status"), *[F.lit(v).alias(n) for n, v in lits.items()])
    return D.order_rule_screen(orders, rules).select("k", "p", "q", "reject_reason")


@check("stable_ids", """WITH f AS (SELECT o_orderkey AS symbol, 'fill_' || sha256('{"eventTime":' || epoch_ms(o_orderdate) || ',"symbol":' || o_orderkey || ',"tradeId":' || o_custkey || '}')[1:32] AS fill_id FROM orders)
SELECT symbol, fill_id, 'int_' || sha256('["' || fill_id || '","x"]')[1:32] AS intent_id FROM f""")
def _stable(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_custkey").alias("tradeId"), ms("o_orderdate").alias("eventTime"))
    fill = D.stable_id("fill_", "symbol", "tradeId", "eventTime")
    return o.select("symbol", fill.alias("fill_id"), D.set_id("int_", F.array(fill, F.lit("x"), fill)).alias("intent_id"))
