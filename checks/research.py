"""Trades, metrics, event study, gates, tuning, months and variants on walk bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import bars as B
from barlight.operators import features as X
from barlight.operators import gates as G
from barlight.operators import trades as T
from barlight.strategies.registry import registry_frame, signals
from barlight.strategies.sweeps import direction_filter, range_reclaim
from checks import strategy_sql as S
from checks.base import bars, bound, check, frame, r6, sql_bars, sql_ticks, table, walk
from checks.indicators import FEATURES_CTE, SETUPS_CTE

START, END = 1_704_067_200_000, 1_706_745_600_000
LATE_START = 1_704_412_800_000

# A few window-only strategies make the signal table of the SQL side.
RULES = {"sr25_donchian_breakout": ("c > ph20", "c < pl20"), "vis_sr_breaks": ("c > ph50", "c < pl50"),
         "vis_fractal_breakout": ("pc <= ph5 AND c > ph5", "pc >= pl5 AND c < pl5"),
         "vis_candlestick_reversal": ("c > o AND pc < po AND o <= pc AND c >= po", "c < o AND pc > po AND o >= pc AND c <= po")}
IDS = list(RULES)


def _cells() -> str:
    return ", ".join(f"{{'strategy_id': '{k}', 'sig': CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END}}" for k, (a, b) in RULES.items())


def signal_cte(src: str = "bars", part: str = "symbol", out: str = "sg") -> str:
    """Signals with the next bar's open and time; ``part`` restarts every window."""
    w = f"WINDOW w AS (PARTITION BY {part} ORDER BY i)"
    p = lambda fn, s, n: f"CASE WHEN row_number() OVER w > {n} THEN {fn}({s}) OVER {frame(-n, -1, part)} END"
    return f"""{out}_x AS (SELECT *, lag(c) OVER w AS pc, lag(o) OVER w AS po, lead(t) OVER w AS nt, lead(o) OVER w AS no,
  {', '.join(f"{p('max', 'h', n)} AS ph{n}, {p('min', 'l', n)} AS pl{n}" for n in (5, 20, 50))} FROM {src} {w}),
{out} AS MATERIALIZED (SELECT * EXCLUDE (u), u.strategy_id AS strategy_id, u.sig AS sig FROM (SELECT *, unnest([{_cells()}]) AS u FROM {out}_x) WHERE u.sig <> 0)"""


def trade_cte(src: str = "sg", out: str = "tr", part: str = "", start: str = "0", base: str = "bars") -> str:
    """Position changes of the acting signals, closed by the next change or the last bar."""
    by = f"symbol, timeframe, strategy_id{part}"
    return f"""{out}_a AS (SELECT *, lag(sig) OVER (PARTITION BY {by} ORDER BY i) AS ps FROM {src} WHERE nt IS NOT NULL AND nt >= {start}),
{out}_b AS (SELECT *, lead(nt) OVER (PARTITION BY {by} ORDER BY i) AS xt, lead(no) OVER (PARTITION BY {by} ORDER BY i) AS xo FROM {out}_a WHERE sig <> coalesce(ps, 0)),
{out}_l AS (SELECT symbol, timeframe{part}, max(t) AS lt, arg_max(c, t) AS lc FROM {base} GROUP BY ALL),
{out} AS MATERIALIZED (SELECT {', '.join('b.' + x.strip() for x in by.split(','))}, sig AS side, nt AS entry_t, coalesce(xt, lt) AS exit_t,
  CASE WHEN sig = 1 THEN coalesce(xo, lc) / no - 1 ELSE no / coalesce(xo, lc) - 1 END AS gross FROM {out}_b b JOIN {out}_l l USING (symbol, timeframe{part}))"""


def metric_sql(src: str, by: str, cost: str, start: str, end: str, clamp: bool = False) -> str:
    """Metrics of each group, equity folded over trades in entry order."""
    third = f"least(2, floor((entry_t - {start}) / (({end} - {start}) / 3.0)))"
    third = f"greatest(0, {third})" if clamp else third
    return f"""SELECT *, CASE WHEN gl < 0 THEN gw / abs(gl) WHEN gw > 0 THEN 999 ELSE 0 END AS pf, CASE WHEN sd > 0 THEN exp / sd * sqrt(n) ELSE 0 END AS sh,
  (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT AS posseg FROM (
  SELECT {by}, count(*) AS n, avg((r > 0)::INT) AS wr, product(greatest(1e-9, 1 + r)) - 1 AS net, max(1 - eq / pk) AS dd, avg(r) AS exp, stddev_samp(r) AS sd,
    coalesce(sum(r) FILTER (r > 0), 0) AS gw, coalesce(sum(r) FILTER (r < 0), 0) AS gl,
    {', '.join(f'coalesce(product(1 + r) FILTER (th = {j}), 1) - 1 AS g{j}' for j in range(3))}
  FROM (SELECT *, greatest(1, max(eq) OVER (PARTITION BY {by} ORDER BY entry_t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS pk FROM (
    SELECT *, product(greatest(1e-9, 1 + r)) OVER (PARTITION BY {by} ORDER BY entry_t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq
    FROM (SELECT *, gross - {cost} AS r, {third} AS th FROM {src}))) GROUP BY {by})"""


VIEWS = "SELECT *, unnest([{'view': 'base', 'cost': 0.0014}, {'view': 'stress', 'cost': 0.0015}, {'view': 'low', 'cost': 0.0006}, {'view': CASE WHEN side = 1 THEN 'long' ELSE 'short' END, 'cost': 0.0014}]) AS vw"


def result_cte(src: str, by: str, start: str, end: str, least: str, out: str = "res", clamp: bool = False) -> str:
    pick = lambda v, c: f"coalesce(max({c}) FILTER (view = '{v}'), 0)"
    return f"""{out}_v AS (SELECT * EXCLUDE (vw), vw.view AS view, CAST(vw.cost AS DOUBLE) AS cost FROM ({VIEWS} FROM {src})),
{out}_m AS ({metric_sql(f'{out}_v', by + ', view', 'cost', start, end, clamp)}),
{out} AS MATERIALIZED (SELECT *, n >= min_trades AND net > 0 AND exp > 0 AND pf > 1.05 AND posseg >= 2 AND net15 > 0 AS pass FROM (SELECT {by}, {least} AS min_trades,
  {', '.join(f"{pick('base', c)} AS {c}" for c in ('n', 'wr', 'net', 'pf', 'dd', 'exp', 'sh', 'posseg', 'g0', 'g1', 'g2'))},
  {pick('stress', 'net')} AS net15, {pick('low', 'net')} AS net6, {pick('long', 'n')} AS long_n, {pick('long', 'net')} AS long_net, {pick('long', 'pf')} AS long_pf,
  {pick('short', 'n')} AS short_n, {pick('short', 'net')} AS short_net, {pick('short', 'dd')} AS short_dd FROM {out}_m GROUP BY {by}))"""


BY = "symbol, timeframe, strategy_id"
RES_COLS = ("wr", "net", "pf", "dd", "exp", "sh", "g0", "g1", "g2", "net15", "net6", "long_net", "long_pf", "short_net", "short_dd")
RES_OUT = f"{BY}, n, posseg, long_n, short_n, min_trades, pass, {', '.join(f'{r6(c)} AS {c}' for c in RES_COLS)}"


def signal_table(spark, sf, ids=IDS, timeframe="15m"):
    return signals(bars(spark, sf, timeframe), ids, bound(spark, sf, timeframe))


def trade_table(spark, sf, ids=IDS, timeframe="15m", start=None):
    return T.trades(signal_table(spark, sf, ids, timeframe), T.last_bars(bars(spark, sf, timeframe)), start)


def result_table(spark, sf, ids=IDS, timeframe="15m"):
    return T.evaluate(trade_table(spark, sf, ids, timeframe), F.lit(START), F.lit(END))


def result_columns(df):
    seg = F.col("seg")
    return df.withColumns({f"g{j}": seg[j] for j in range(3)}).select(
        *BY.split(", "), "n", "posseg", "long_n", "short_n", "min_trades", "pass", *RES_COLS)


@check("flagship_channel_break", f"""WITH {walk()}, {signal_cte()}, {trade_cte("(SELECT * FROM sg WHERE strategy_id = 'sr25_donchian_breakout')")},
{result_cte('tr', BY, str(START), str(END), '25')},
k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, timeframe ORDER BY net DESC, symbol) AS rank FROM res)
SELECT {RES_OUT}, rank FROM k WHERE rank <= 5""")
def _flagship(spark, sf):
    from pyspark.sql import Window

    rows = result_columns(result_table(spark, sf, ["sr25_donchian_breakout"]))
    w = Window.partitionBy("strategy_id", "timeframe").orderBy(F.desc("net"), "symbol")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


@check("reversal_trades", f"WITH {walk()}, {signal_cte()}, {trade_cte(start=str(LATE_START))} SELECT {BY}, side, entry_t, exit_t, {r6('gross')} AS gross FROM tr")
def _reversal(spark, sf):
    return trade_table(spark, sf, start=LATE_START)


TARGET_CTE = f"""tg AS (SELECT *, CASE WHEN hr < 8 THEN 1 WHEN hr < 16 THEN -1 ELSE 0 END AS tp FROM (SELECT *, (t // 3600000) % 24 AS hr, lead(t) OVER w AS nt, lead(o) OVER w AS no
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i))),
tgs AS (SELECT symbol, timeframe, 'hour_sides' AS strategy_id, i, t, nt, no, tp AS sig FROM tg)"""


def target_signals(spark, sf):
    """Target positions by UTC hour: long, short, flat."""
    from pyspark.sql import Window

    hour = F.floor(F.col("t") / 3_600_000) % 24
    w = Window.partitionBy("symbol", "timeframe").orderBy("t")
    rows = bars(spark, sf).withColumn("sig", F.when(hour < 8, 1).when(hour < 16, -1).otherwise(0))
    return rows.select("symbol", "timeframe", F.lit("hour_sides").alias("strategy_id"), F.lit("TARGET_POSITION").alias("mode"), "t", "sig",
                       F.lead("t").over(w).alias("next_t"), F.lead("o").over(w).alias("next_o"))


@check("target_trades", f"""WITH {walk()}, {TARGET_CTE}, {trade_cte('tgs', 'tr0', start=str(LATE_START))}
SELECT {BY}, side, entry_t, exit_t, {r6('gross')} AS gross FROM tr0 WHERE side <> 0""")
def _target(spark, sf):
    return T.trades(target_signals(spark, sf), T.last_bars(bars(spark, sf)), LATE_START)


@check("evaluated_strategies", f"WITH {walk()}, {signal_cte()}, {trade_cte()}, {result_cte('tr', BY, str(START), str(END), '25')} SELECT {RES_OUT} FROM res")
def _evaluated(spark, sf):
    return result_columns(result_table(spark, sf))


@check("evaluated_without_stress", f"""WITH {walk()}, {signal_cte()}, {trade_cte()}, {result_cte('tr', BY, str(START), str(END), '5')}
SELECT {BY}, n, {r6('net')} AS net, n >= 5 AND net > 0 AND exp > 0 AND pf > 1.05 AND posseg >= 2 AS pass FROM res""")
def _no_stress(spark, sf):
    return T.evaluate(trade_table(spark, sf), F.lit(START), F.lit(END), least=F.lit(5), require_stress=False).select(*BY.split(", "), "n", "net", "pass")


def catalogue_sql() -> str:
    """Signals of all strategies, each group by its own SQL, through trades and metrics."""
    from checks.strategies import GROUPS

    groups = " UNION ALL ".join(f"SELECT symbol, timeframe, strategy_id, t, sig FROM ({sql})" for _, sql in GROUPS.values())
    return f"""WITH {walk()}, sa AS MATERIALIZED ({groups}), nx AS (SELECT symbol, t, i, lead(t) OVER w AS nt, lead(o) OVER w AS no FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
sg AS MATERIALIZED (SELECT sa.symbol, timeframe, strategy_id, sa.t, sig, i, nt, no FROM sa JOIN nx ON nx.symbol = sa.symbol AND nx.t = sa.t), {trade_cte(out='tr0')}, tr AS (SELECT * FROM tr0 WHERE side <> 0),
{result_cte('tr', BY, str(START), str(END), '25')} SELECT {RES_OUT} FROM res"""


@check("whole_catalogue_scan", catalogue_sql())
def _scan(spark, sf):
    return result_columns(result_table(spark, sf, None))


@check("min_trades_lookup", f"""WITH {sql_ticks()}, {', '.join(sql_bars(tf, f'b{tf}') for tf in ('5m', '15m', '1h', '4h'))}, u AS (
{' UNION ALL '.join(f'SELECT symbol, timeframe FROM b{tf}' for tf in ('5m', '15m', '1h', '4h'))})
SELECT timeframe, count(*) AS bars, CASE timeframe WHEN '5m' THEN 30 WHEN '15m' THEN 25 WHEN '1h' THEN 20 ELSE 10 END AS min_trades FROM u GROUP BY 1""")
def _min_trades(spark, sf):
    many = B.resample_many(bars(spark, sf, "1m"), ["5m", "15m", "1h", "4h"])
    return many.groupBy("timeframe").agg(F.count("*").alias("bars")).withColumn("min_trades", T.min_trades(F.col("timeframe")))


def registry_sql() -> str:
    """Identity and convergence of each strategy, and how often its own SQL fires on hourly bars."""
    from barlight.strategies.registry import CONVERGENCE, DEFAULT_CONVERGENCE, catalogue
    from checks.strategies import GROUPS

    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    known = ", ".join(f"({', '.join(map(text, (k.id, k.name, k.family, k.version, k.mode, *CONVERGENCE.get(k.id, DEFAULT_CONVERGENCE))))})" for k in catalogue().values())
    hourly = [sql.replace(walk(), walk("1h")) for _, sql in GROUPS.values()]
    groups = " UNION ALL ".join(f"SELECT symbol, timeframe, strategy_id, t, sig FROM ({sql})" for sql in hourly)
    return f"""WITH sa AS ({groups}), known(strategy_id, name, family, version, mode, warmup_bars, convergence, anchor) AS (VALUES {known}),
fired AS (SELECT strategy_id, count(*) AS signals FROM sa GROUP BY 1)
SELECT known.* REPLACE (CAST(warmup_bars AS BIGINT) AS warmup_bars), coalesce(signals, 0) AS signals FROM known LEFT JOIN fired USING (strategy_id)"""


@check("strategy_registry", registry_sql())
def _registry(spark, sf):
    # The catalogue next to how often each strategy fires on the given ticks.
    fired = signals(bars(spark, sf, "1h"), None, bound(spark, sf, "1h")).groupBy("strategy_id").agg(F.count("*").alias("signals"))
    return registry_frame(spark).join(fired, "strategy_id", "left").na.fill(0)


@check("direction_filtered_targets", f"""WITH {walk()}, {TARGET_CTE} SELECT symbol, t, CASE WHEN sig = 1 THEN 1 ELSE 0 END AS long_only, CASE WHEN sig = -1 THEN -1 ELSE 0 END AS short_only, sig AS both FROM tgs""")
def _direction(spark, sf):
    s = target_signals(spark, sf)
    return s.select("symbol", "t", *[direction_filter(F.col("sig"), m).alias(n) for n, m in (("long_only", "long"), ("short_only", "short"), ("both", "both"))])


# --- event study -----------------------------------------------------------------------

FIRES = "(kind = 'breakout' AND a >= 0.2) OR (kind = 'liquidity_sweep_reclaim' AND a >= 0.15 AND b >= 0.05) OR (kind = 'compression_release' AND a >= 0.2 AND b >= 0.25 AND d >= 1.25)"


def study_cte(horizons=(3, 6, 12, 24), costs=(("base", 0.001), ("stress", 0.0016)), fires: str = FIRES) -> str:
    lead = ", ".join(f"lead(c, {k}) OVER w AS x{k}, max(h) OVER {frame(1, k)} AS hi{k}, min(l) OVER {frame(1, k)} AS lo{k}" for k in horizons)
    cells = ", ".join(f"{{'horizon': {k}, 'cost_name': '{n}', 'cost': CAST({c} AS DOUBLE), 'x': x{k}, 'hi': hi{k}, 'lo': lo{k}}}" for k in horizons for n, c in costs)
    return f"""paths AS (SELECT symbol, i, {lead}, count(*) OVER (PARTITION BY symbol) AS nn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)),
wf AS (SELECT *, CAST(floor(nn * 0.6) AS BIGINT) AS a1, CAST(floor(nn * 0.8) AS BIGINT) AS a2 FROM paths),
oc0 AS (SELECT e.*, g.horizon AS horizon, g.cost_name AS cost_name, g.cost AS cost, g.x AS x, g.hi AS hi, g.lo AS lo,
  CASE WHEN e.i < a1 THEN 'train' WHEN e.i < a2 THEN 'validation' ELSE 'holdout' END AS wf, CASE WHEN e.i < a1 THEN a1 WHEN e.i < a2 THEN a2 ELSE nn END AS stop
  FROM (SELECT e.*, a1, a2, nn, unnest([{cells}]) AS g FROM ev e JOIN wf ON wf.symbol = e.symbol AND wf.i = e.i WHERE {fires}) e),
oc AS MATERIALIZED (SELECT *, direction * (x - c) / c AS gross, direction * (x - c) / c - cost AS net, least(direction * (hi - c) / c, direction * (lo - c) / c) AS mae,
  greatest(direction * (hi - c) / c, direction * (lo - c) / c) AS mfe FROM oc0 WHERE i + horizon < stop AND x IS NOT NULL)"""


SUM_COLS = ("hit_rate", "gross_exp", "net_exp", "avg_win", "avg_loss", "avg_mae", "avg_mfe", "break_even_cost")
STATS_CTE = """keys AS (SELECT * FROM (SELECT DISTINCT symbol, timeframe FROM ev), (VALUES ('breakout'), ('liquidity_sweep_reclaim'), ('compression_release')) k(kind),
  (VALUES ('train'), ('validation'), ('holdout')) w(wf), (SELECT DISTINCT horizon, cost_name FROM oc)),
st AS (SELECT k.symbol, k.timeframe, k.kind, k.wf, k.horizon, k.cost_name, count(net) AS n, coalesce(avg((net > 0)::INT), 0) AS hit_rate, coalesce(avg(gross), 0) AS gross_exp, coalesce(avg(net), 0) AS net_exp,
  coalesce(avg(net) FILTER (net > 0), 0) AS avg_win, coalesce(avg(net) FILTER (net <= 0), 0) AS avg_loss, coalesce(avg(mae), 0) AS avg_mae, coalesce(avg(mfe), 0) AS avg_mfe,
  greatest(0, coalesce(avg(gross), 0)) AS break_even_cost
  FROM keys k LEFT JOIN oc USING (symbol, timeframe, kind, wf, horizon, cost_name) GROUP BY 1, 2, 3, 4, 5, 6)"""
STUDY = f"WITH {walk()},\n{FEATURES_CTE},\n{SETUPS_CTE},\n{study_cte()}"


def _rows(spark, sf):
    return X.features(bars(spark, sf), longest=bound(spark, sf))


@check("event_outcomes", f"{STUDY} SELECT symbol, timeframe, t, kind, wf, horizon, cost_name, direction, {', '.join(f'{r6(x)} AS {x}' for x in ('gross', 'net', 'mae', 'mfe'))} FROM oc")
def _outcomes(spark, sf):
    ev = G.study_events(_rows(spark, sf), G.HORIZONS)
    return X.outcomes(ev, G.HORIZONS, G.COSTS).select("symbol", "timeframe", "t", "kind", "wf", "horizon", "cost_name", "direction", "gross", "net", "mae", "mfe")


@check("walk_forward_study", f"{STUDY},\n{STATS_CTE} SELECT symbol, timeframe, kind, wf, horizon, cost_name, n, {', '.join(f'{r6(x)} AS {x}' for x in SUM_COLS)} FROM st")
def _study(spark, sf):
    return G.walk_forward_study(G.study_events(_rows(spark, sf), G.HORIZONS), G.HORIZONS)


DECIDE = """dec AS (SELECT symbol, timeframe, kind, horizon, cost_name, CASE WHEN vn < 10 OR hn < 10 THEN 'INSUFFICIENT_DATA' WHEN ve <= 0 OR he <= 0 THEN 'REJECT' ELSE 'PASS' END AS status, vn, hn, ve, he FROM (
  SELECT symbol, timeframe, kind, horizon, cost_name, max(n) FILTER (wf = 'validation') AS vn, max(n) FILTER (wf = 'holdout') AS hn, max(net_exp) FILTER (wf = 'validation') AS ve,
  max(net_exp) FILTER (wf = 'holdout') AS he FROM st GROUP BY 1, 2, 3, 4, 5)),
mx AS (SELECT symbol, timeframe, kind, CASE WHEN bool_or(status = 'INSUFFICIENT_DATA') THEN 'INSUFFICIENT_DATA' WHEN bool_or(status <> 'PASS') THEN 'REJECT' ELSE 'PASS' END AS status,
  count(*) FILTER (status = 'PASS') AS passed_runs, count(*) AS total_runs FROM dec GROUP BY 1, 2, 3)"""


@check("promotion_decisions", f"{STUDY},\n{STATS_CTE},\n{DECIDE} SELECT symbol, timeframe, kind, horizon, cost_name, status, vn, hn, {r6('ve')} AS ve, {r6('he')} AS he FROM dec")
def _promotion(spark, sf):
    stats = G.walk_forward_study(G.study_events(_rows(spark, sf), G.HORIZONS), G.HORIZONS)
    return G.decide_promotion(stats, ["symbol", "timeframe", "horizon", "cost_name"], 10).drop("reasons")


def _grid() -> str:
    rows = [("breakout", i, a, None, None) for i, a in enumerate(G.GRID_BREAKOUT)]
    rows += [("liquidity_sweep_reclaim", i, a, b, None) for i, (a, b) in enumerate((a, b) for a in G.GRID_SWEEP for b in G.GRID_RECLAIM)]
    rows += [("compression_release", i, a, b, d) for i, (a, b, d) in enumerate((a, b, d) for a in G.GRID_DEPTH for b in G.GRID_DURATION for d in G.GRID_EXPANSION)]
    lit = lambda x: "NULL" if x is None else f"{x}"
    return ", ".join(f"('{k}', {i}, {lit(a)}, {lit(b)}, {lit(d)})" for k, i, a, b, d in rows)


def tuned_cte(least: int, oc: str = "oc") -> str:
    """``tuned``: the best grid point of each series and setup over the train rows of ``oc``."""
    return f"""grid AS (SELECT kind, point, CAST(ga AS DOUBLE) AS ga, CAST(gb AS DOUBLE) AS gb, CAST(gd AS DOUBLE) AS gd FROM (VALUES {_grid()}) g(kind, point, ga, gb, gd)),
s AS (SELECT b.symbol, b.timeframe, g.kind, g.point, ga, gb, gd, count(net) AS n, coalesce(avg(net), 0) AS net_exp FROM (SELECT DISTINCT symbol, timeframe FROM bars) b CROSS JOIN grid g
  LEFT JOIN {oc} oc ON oc.symbol = b.symbol AND oc.kind = g.kind AND oc.wf = 'train' AND oc.a >= ga AND (gb IS NULL OR oc.b >= gb) AND (gd IS NULL OR oc.d >= gd) GROUP BY ALL),
tuned AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY n >= {least} DESC, round(net_exp, 12) DESC, n DESC, point) AS k FROM s) WHERE k = 1)"""


# Outcomes of every candidate at the tuned horizon (names t_...), the thresholds from them, then the study of what fires.
TUNED_FIRES = "EXISTS (SELECT 1 FROM tuned u WHERE u.symbol = e.symbol AND u.kind = e.kind AND e.a >= u.ga AND (u.gb IS NULL OR e.b >= u.gb) AND (u.gd IS NULL OR e.d >= u.gd))"
_FIRST = study_cte((12,), (("base", 0.001),), "true").replace("paths", "t_paths").replace("wf AS (", "t_wf AS (").replace("JOIN wf ON wf.symbol = e.symbol AND wf.i", "JOIN t_wf ON t_wf.symbol = e.symbol AND t_wf.i").replace("oc0", "t_oc0").replace("oc AS MAT", "t_oc AS MAT")
TUNED_STUDY = f"WITH {walk()},\n{FEATURES_CTE},\n{SETUPS_CTE},\n{_FIRST},\n{tuned_cte(10, 't_oc')},\n{study_cte(fires=TUNED_FIRES)}"
ALL_STATS = STATS_CTE.replace("(SELECT DISTINCT symbol, timeframe FROM ev)", "(SELECT DISTINCT symbol, timeframe FROM bars)").replace(
    "(SELECT DISTINCT horizon, cost_name FROM oc)", "(VALUES (3), (6), (12), (24)) hz(horizon), (VALUES ('base'), ('stress')) cs(cost_name)")
MATRIX_OUT = "SELECT symbol, timeframe, kind, status, passed_runs, total_runs FROM mx"


@check("robustness_matrix", f"{TUNED_STUDY},\n{ALL_STATS},\n{DECIDE} {MATRIX_OUT}")
def _matrix(spark, sf):
    return G.robustness_matrix(_rows(spark, sf), min_n=10).drop("reason")


@check("robustness_fixed_thresholds", f"{STUDY},\n{STATS_CTE},\n{DECIDE} {MATRIX_OUT}")
def _fixed_matrix(spark, sf):
    return G.robustness_matrix(_rows(spark, sf), min_n=10, tune=False).drop("reason")


@check("acceptance_report", f"""{TUNED_STUDY},\n{ALL_STATS},\n{DECIDE}, gd AS (SELECT symbol, timeframe, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS d FROM bars),
gm AS (SELECT symbol, d AS m FROM (SELECT symbol, d, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, d) AS k FROM gd WHERE d > 0 GROUP BY 1, 2) WHERE k = 1),
gq AS (SELECT gd.symbol, timeframe, NOT bool_or(coalesce(d / m > 1.5, false)) AS ok FROM gd JOIN gm ON gm.symbol = gd.symbol GROUP BY 1, 2),
pr AS (SELECT symbol, string_agg(kind, ',' ORDER BY kind) FILTER (status = 'PASS') AS kinds FROM mx GROUP BY 1)
SELECT gq.symbol, timeframe, ok AS quality_pass, CASE WHEN ok THEN coalesce(kinds, '') ELSE '' END AS promotable,
  CASE WHEN NOT ok THEN 'DATA_QUALITY_FAIL' WHEN kinds IS NOT NULL THEN 'PROMOTABLE_SETUP_FOUND' ELSE 'NO_PROMOTABLE_SETUP' END AS verdict FROM gq JOIN pr ON pr.symbol = gq.symbol""")
def _acceptance(spark, sf):
    b = bars(spark, sf)
    quality = B.quality_report(b, "t", chunk_size=2_592_000_000)
    return G.acceptance_report(quality, G.robustness_matrix(_rows(spark, sf), min_n=10))


@check("tuned_thresholds", f"""WITH {walk()},\n{FEATURES_CTE},\n{SETUPS_CTE},\n{study_cte((12,), (('base', 0.001),), 'true')},
{tuned_cte(30)}
SELECT symbol, timeframe, kind, {r6('ga')} AS ga, {r6('gb')} AS gb, {r6('gd')} AS gd, n, {r6('net_exp')} AS net_exp FROM tuned""")
def _tuned(spark, sf):
    return G.tune_thresholds(_rows(spark, sf)).drop("point")


# --- months -----------------------------------------------------------------------------

@check("monthly_roll_forward", f"""WITH {walk('1h')}, {signal_cte()}, {trade_cte()}, wn AS (SELECT '2024-01' AS month, {START} AS s, {END} AS e),
m AS (SELECT {BY}, strftime(make_timestamp(exit_t * 1000), '%Y-%m') AS month, gross * 1000 - 1.4 AS profit, exit_t FROM tr),
a AS (SELECT {BY}, month, count(*) AS n, sum(profit) AS p, coalesce(sum(profit) FILTER (profit > 0), 0) AS gw, coalesce(sum(profit) FILTER (profit < 0), 0) AS gl,
  {', '.join(f'coalesce(sum(profit) FILTER (greatest(0, least(2, floor((exit_t - {START}) / (({END} - {START}) / 3.0)))) = {j}), 0) AS g{j}' for j in range(3))} FROM m GROUP BY ALL)
SELECT {BY}, month, n, {r6('p')} AS net_profit, 10000.0 AS start_equity, {r6('p / 100')} AS ret_pct, {r6('CASE WHEN gl < 0 THEN gw / -gl WHEN gw > 0 THEN 999 ELSE 0 END')} AS pf,
  (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT AS posseg, n >= 3 AND p > 0 AND (CASE WHEN gl < 0 THEN gw / -gl WHEN gw > 0 THEN 999 ELSE 0 END) > 1.05 AND (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT >= 2 AS pass FROM a""")
def _roll(spark, sf):
    t = trade_table(spark, sf, timeframe="1h").withColumn("profit", F.col("gross") * 1000 - 1.4)
    return T.monthly_roll_forward(t, B.month_windows(spark, START, END), BY.split(", "), 10_000.0, 3)


# Long histories: line items as currency trades over seven years.
CURRENCY = """ct AS (SELECT l_returnflag AS symbol, l_linestatus AS strategy_id, epoch_ms(l_shipdate) AS exit_t, round((l_quantity - 25) * 4 + l_discount * 100, 2) AS profit FROM lineitem)"""
C_START, C_END = 788_918_400_000, 1_009_843_200_000


def currency_trades(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("strategy_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("exit_t"),
        F.round((F.col("l_quantity") - 25) * 4 + F.col("l_discount") * 100, 2).alias("profit"))


_TH = f"greatest(0, least(2, floor((exit_t - {C_START}) / (({C_END} - {C_START}) / 3.0))))"
_PF = "CASE WHEN gl < 0 THEN gw / -gl WHEN gw > 0 THEN 999 ELSE 0 END"


@check("currency_metrics", f"""WITH {CURRENCY}, a AS (SELECT symbol, strategy_id, count(*) AS n, count(*) FILTER (profit > 0) AS wins, sum(profit) AS p, coalesce(sum(profit) FILTER (profit > 0), 0) AS gw,
  coalesce(sum(profit) FILTER (profit < 0), 0) AS gl, {', '.join(f'coalesce(sum(profit) FILTER ({_TH} = {j}), 0) AS g{j}' for j in range(3))} FROM ct GROUP BY 1, 2)
SELECT symbol, strategy_id, n, {r6('p')} AS net_profit, {r6('p / 1000')} AS net_pct, {r6('wins / n')} AS wr, {r6(_PF)} AS pf, (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT AS posseg,
  n >= 20 AND p > 0 AND {_PF} > 1.05 AND (g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT >= 2 AS pass FROM a""")
def _currency(spark, sf):
    return T.currency_metrics(currency_trades(spark, sf), ["symbol", "strategy_id"], 100_000.0, C_START, C_END, 20).select(
        "symbol", "strategy_id", "n", "net_profit", "net_pct", "wr", "pf", "posseg", "pass")


ROLL = f"""{CURRENCY}, wn AS (SELECT strftime(d, '%Y-%m') AS month, epoch_ms(d) AS s, epoch_ms(d + INTERVAL 1 MONTH) AS e FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d)),
pr AS (SELECT symbol, strategy_id, w.month, profit, greatest(0, least(2, floor((exit_t - s) / ((e - s) / 3.0)))) AS th FROM ct JOIN wn w ON exit_t >= s AND exit_t < e),
a AS (SELECT symbol, strategy_id, month, count(*) AS n, sum(profit) AS p, coalesce(sum(profit) FILTER (profit > 0), 0) AS gw, coalesce(sum(profit) FILTER (profit < 0), 0) AS gl,
  {', '.join(f'coalesce(sum(profit) FILTER (th = {j}), 0) AS g{j}' for j in range(3))} FROM pr GROUP BY 1, 2, 3),
rm AS MATERIALIZED (SELECT k.symbol, k.strategy_id, k.month, coalesce(n, 0) AS n, coalesce(p, 0) AS p, 100000 + coalesce(sum(p) OVER (PARTITION BY k.symbol, k.strategy_id ORDER BY k.month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS eq,
  coalesce({_PF}, 0) AS pf, coalesce((g0 > 0)::INT + (g1 > 0)::INT + (g2 > 0)::INT, 0) AS posseg FROM (SELECT * FROM (SELECT DISTINCT symbol, strategy_id FROM ct), (SELECT month FROM wn)) k LEFT JOIN a USING (symbol, strategy_id, month)),
rp AS (SELECT *, n >= 5 AND p > 0 AND pf > 1.05 AND posseg >= 2 AS pass FROM rm)"""


def roll_months(spark, sf):
    return T.monthly_roll_forward(currency_trades(spark, sf), B.month_windows(spark, C_START, C_END), ["symbol", "strategy_id"], 100_000.0, 5)


@check("monthly_roll_long", f"WITH {ROLL} SELECT symbol, strategy_id, month, n, {r6('p')} AS net_profit, {r6('eq')} AS start_equity, {r6('CASE WHEN eq > 0 THEN p / eq * 100 END')} AS ret_pct, {r6('pf')} AS pf, posseg, pass FROM rp")
def _roll_long(spark, sf):
    return roll_months(spark, sf)


@check("exit_month_grades", f"""WITH {ROLL}, c AS (SELECT symbol, strategy_id, count(*) FILTER (pass) AS pass_months, count(*) AS months FROM rp WHERE month < '1995-10' GROUP BY 1, 2)
SELECT symbol, strategy_id, pass_months, months, CASE WHEN pass_months = 9 THEN 'A_9_OF_9' WHEN pass_months = 8 THEN 'B_8_OF_9' ELSE 'REJECT' END AS grade FROM c""")
def _exit_grades(spark, sf):
    runs = currency_trades(spark, sf).select("symbol", "strategy_id").distinct().withColumn("pass", F.lit(True))
    return G.exit_month_grade(runs, roll_months(spark, sf).where("month < '1995-10'"), ["symbol", "strategy_id"]).drop("pass")


# Monthly rows of many keys: orders by customer and month.
MONTHS = """mo AS (SELECT 'C' || (o_custkey % 40) AS symbol, '1h' AS timeframe, 's' || (o_custkey % 3) AS strategy_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice) / 250000 - 1, 4) AS net,
  round(avg(o_totalprice) / 250000 - 1.01, 4) AS net15, round(max(o_totalprice) / 1000000, 4) AS dd, count(*) > 2 AS eligible, avg(o_totalprice) > 240000 AS pass FROM orders GROUP BY 1, 2, 3, 4)"""


def month_rows(spark, sf):
    o = table(spark, sf, "orders")
    k, p = F.col("o_custkey"), F.col("o_totalprice")
    return o.groupBy(F.concat(F.lit("C"), (k % 40).cast("string")).alias("symbol"), F.lit("1h").alias("timeframe"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("strategy_id"),
                     F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.round(F.avg(p) / 250000 - 1, 4).alias("net"), F.round(F.avg(p) / 250000 - 1.01, 4).alias("net15"),
        F.round(F.max(p) / 1000000, 4).alias("dd"), (F.count("*") > 2).alias("eligible"), (F.avg(p) > 240000).alias("pass"))


COUNTS = f"""{MONTHS}, cn AS (SELECT {BY}, count(*) FILTER (eligible) AS e, count(*) FILTER (eligible AND pass) AS p, count(*) FILTER (eligible AND net > 0) AS pos, count(*) FILTER (eligible AND net15 > 0) AS spos FROM mo GROUP BY 1, 2, 3)"""


@check("monthly_grades", f"""WITH {COUNTS} SELECT {BY}, e AS eligible_months, p AS pass_months, pos AS positive_months, spos AS stress_positive_months, {r6('CASE WHEN e > 0 THEN p / e ELSE 0 END')} AS pass_ratio,
  CASE WHEN e >= 9 AND p >= 9 THEN 'A_9_OF_9' WHEN e >= 9 AND p >= 8 THEN 'B_8_OF_9' WHEN e >= 6 AND p / e >= 0.80 THEN 'C_80PCT_SHORTER' ELSE 'REVIEW' END AS grade FROM cn""")
def _grades(spark, sf):
    return G.monthly_grade(G.monthly_counts(month_rows(spark, sf), BY.split(", ")))


YEAR = f"""{COUNTS}, yr AS (SELECT cn.*, a.net15, a.pf, a.n FROM cn JOIN (SELECT {BY}, sum(net15) AS net15, 1 + sum(net) AS pf, CAST(sum(n) AS BIGINT) AS n FROM mo GROUP BY 1, 2, 3) a USING (symbol, timeframe, strategy_id)),
gr AS (SELECT *, CASE WHEN e >= 9 AND p = e THEN 'A_ALL_MONTHS' WHEN e >= 9 AND p = e - 1 THEN 'B_ONE_MISS' WHEN e >= 6 AND net15 > 0 AND pf > 1.05 THEN 'C_POSITIVE_REVIEW' ELSE 'FAIL_REVIEW' END AS year_grade FROM yr)"""


def _year_rows(spark, sf):
    m, by = month_rows(spark, sf), BY.split(", ")
    return G.monthly_counts(m, by).join(m.groupBy(*by).agg(F.sum("net15").alias("net15"), (1 + F.sum("net")).alias("pf"), F.sum("n").alias("n")), by)


@check("year_grades", f"WITH {YEAR} SELECT {BY}, e AS eligible_months, p AS pass_months, year_grade, CASE WHEN year_grade IN ('A_ALL_MONTHS', 'B_ONE_MISS') THEN year_grade ELSE 'REVIEW' END AS plain_grade FROM gr")
def _year(spark, sf):
    plain = G.year_grade(_year_rows(spark, sf)).withColumnRenamed("year_grade", "plain_grade")
    return G.year_grade(plain, extended=True).select(*BY.split(", "), "eligible_months", "pass_months", "year_grade", "plain_grade")


@check("accepted_combinations", f"WITH {YEAR} SELECT {BY}, year_grade, p AS pass_months, {r6('net15')} AS net15, n FROM gr WHERE year_grade <> 'FAIL_REVIEW'")
def _accepted(spark, sf):
    return G.accepted(G.year_grade(_year_rows(spark, sf), extended=True), extended=True).select(*BY.split(", "), "year_grade", "pass_months", "net15", "n")


@check("accepted_counts", f"WITH {YEAR} SELECT timeframe, year_grade AS grade, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM gr GROUP BY 1, 2")
def _accepted_counts(spark, sf):
    return G.accepted_counts(G.year_grade(_year_rows(spark, sf), extended=True).withColumnRenamed("year_grade", "grade"))


SUFFIX = f"""{MONTHS}, rk AS (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY month DESC) AS k FROM mo),
sx AS (SELECT symbol, timeframe, strategy_id, l AS last, count(*) AS months, CAST(sum(n) AS BIGINT) AS trades, product(1 + net) - 1 AS net, count(*) FILTER (net > 0) AS positive, count(*) FILTER (pass) AS passed, max(dd) AS dd
  FROM rk, (VALUES (12), (9), (6), (3)) v(l) WHERE k <= l GROUP BY 1, 2, 3, 4),
dl AS (SELECT x.*, x.net - b.net AS delta_net, x.positive - b.positive AS delta_positive, x.dd - b.dd AS delta_dd FROM sx x LEFT JOIN (SELECT * FROM sx WHERE strategy_id = 's0') b ON b.symbol = x.symbol AND b.last = x.last)"""


def _deltas(spark, sf):
    return G.tuning_deltas(G.suffix_summaries(month_rows(spark, sf), BY.split(", ")), ["symbol", "timeframe"], "strategy_id", "s0")


@check("suffix_deltas", f"WITH {SUFFIX} SELECT {BY}, last, months, trades, {r6('net')} AS net, positive, passed, {r6('dd')} AS dd, {r6('delta_net')} AS delta_net, delta_positive, {r6('delta_dd')} AS delta_dd FROM dl")
def _suffix(spark, sf):
    return _deltas(spark, sf).select(*BY.split(", "), "last", "months", "trades", "net", "positive", "passed", "dd", "delta_net", "delta_positive", "delta_dd")


@check("tuning_top_configs", f"WITH {SUFFIX} SELECT {BY}, last, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, last ORDER BY positive DESC, net DESC, dd, strategy_id) AS rank FROM dl) WHERE rank <= 2")
def _top_configs(spark, sf):
    return G.top_configs(_deltas(spark, sf), ["symbol", "timeframe", "last"], "strategy_id", 2).select(*BY.split(", "), "last", "rank")


@check("tuning_common_configs", f"""WITH {SUFFIX} SELECT strategy_id, last, count(*) AS candidates, {r6('median(net)')} AS median_net, {r6('median(dd)')} AS median_dd, {r6('median(delta_net)')} AS median_delta,
  count(*) FILTER (net > 0) AS positive_candidates FROM dl GROUP BY 1, 2""")
def _common(spark, sf):
    return G.common_configs(_deltas(spark, sf), "strategy_id")


@check("holdout_split", f"WITH {MONTHS}, rk AS (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY month DESC) AS k FROM mo WHERE eligible) SELECT {BY}, month, CASE WHEN k <= 3 THEN 'holdout' ELSE 'discovery' END AS split FROM rk")
def _holdout(spark, sf):
    return G.holdout_split(month_rows(spark, sf), BY.split(", "), 3).select(*BY.split(", "), "month", "split")


NEAR = f"""{MONTHS}, seeds AS (SELECT DISTINCT {BY} FROM mo), rs AS (SELECT {BY}, count(*) * 10.0 AS history_days, sum(net) AS net, sum(n) AS n FROM mo WHERE symbol <> 'C7' GROUP BY 1, 2, 3),
fl AS (SELECT 'C7' AS symbol, '1h' AS timeframe, 'PARTIAL_LIFETIME_COVERAGE' AS reason), mm AS (SELECT {BY}, count(*) AS e, count(*) FILTER (pass) AS p, coalesce(string_agg(month, ',' ORDER BY month) FILTER (NOT pass), '') AS failed FROM mo WHERE n >= 3 GROUP BY 1, 2, 3)"""


@check("near_pass_baseline", f"""WITH {NEAR} SELECT s.symbol, s.timeframe, s.strategy_id, CASE WHEN net IS NULL THEN CASE reason WHEN 'TOO_SHORT_HISTORY' THEN 'SHORT_HISTORY' WHEN 'PARTIAL_LIFETIME_COVERAGE' THEN 'DATA_GAP' WHEN 'ERROR' THEN 'ERROR' ELSE 'NO_RESULT' END
  WHEN history_days < 180 THEN 'YOUNG_COIN' WHEN history_days < 540 THEN 'SHORTER_LISTING_HISTORY' ELSE 'FULL_HISTORY' END AS status,
  CASE WHEN net IS NOT NULL THEN CASE WHEN coalesce(e, 0) = 0 THEN 'NO_ELIGIBLE_MONTHS' WHEN p = e THEN 'ALL_MONTHS_PASS' WHEN p = e - 1 THEN 'ONE_MONTH_SHORT' WHEN p / e >= 0.8 THEN 'GE80PCT' ELSE 'BELOW80PCT' END END AS consistency,
  coalesce(e, 0) AS eligible_months, coalesce(p, 0) AS pass_months, failed AS failed_months FROM seeds s LEFT JOIN rs USING (symbol, timeframe, strategy_id) LEFT JOIN fl USING (symbol, timeframe) LEFT JOIN mm USING (symbol, timeframe, strategy_id)""")
def _near(spark, sf):
    m, by = month_rows(spark, sf), BY.split(", ")
    results = m.where("symbol <> 'C7'").groupBy(*by).agg((F.count("*") * 10.0).alias("history_days"), F.sum("net").alias("net"), F.lit(1.0).alias("pf"), F.max("dd").alias("dd"), F.sum("n").alias("n"))
    failures = m.where("symbol = 'C7'").select("symbol", "timeframe").distinct().withColumn("reason", F.lit("PARTIAL_LIFETIME_COVERAGE"))
    monthly = m.withColumns({"days": F.when(F.col("n") >= 3, 25).otherwise(10), "coverage": F.lit(1.0)})
    return G.near_pass_baseline(m.select(*by).distinct(), results, failures, monthly).select(*by, "status", "consistency", "eligible_months", "pass_months", "failed_months")


@check("metric_parity", f"""WITH {MONTHS}, a AS (SELECT {BY}, arg_max(net, n) AS x FROM (SELECT {BY}, month, n * 100 + row_number() OVER (PARTITION BY {BY} ORDER BY month) AS n, net FROM mo) GROUP BY 1, 2, 3),
b AS (SELECT {BY}, CASE WHEN symbol = 'C1' THEN x + 0.001 ELSE x END AS y FROM a WHERE symbol <> 'C2')
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.timeframe, b.timeframe) AS timeframe, coalesce(a.strategy_id, b.strategy_id) AS strategy_id,
  CASE WHEN x IS NULL THEN 'MISSING_LEFT' WHEN y IS NULL THEN 'MISSING_RIGHT' WHEN abs(x - y) <= 1e-9 * greatest(1, abs(x), abs(y)) THEN 'MATCH' ELSE 'DIFFERENT' END AS status
FROM a FULL JOIN b ON a.symbol = b.symbol AND a.strategy_id = b.strategy_id""")
def _parity(spark, sf):
    from pyspark.sql import Window

    by = BY.split(", ")
    m = month_rows(spark, sf).withColumn("n", F.col("n") * 100 + F.row_number().over(Window.partitionBy(*by).orderBy("month")))
    other = m.where("symbol <> 'C2'").withColumn("net", F.when(F.col("symbol") == "C1", F.col("net") + 0.001).otherwise(F.col("net")))
    return G.metric_parity(m, other, by, ["net"]).select(*by, "status")


@check("monthly_eval_sliced", f"""WITH {walk('1h')}, pb AS (SELECT *, strftime(make_timestamp(t * 1000), '%Y-%m') AS month FROM bars), {signal_cte('pb', 'symbol, month')},
{trade_cte(part=', month', base='pb')}, {result_cte('tr', BY + ', month', str(START), str(END), '5')} SELECT {BY}, month, n, {r6('net')} AS net, {r6('dd')} AS dd, {r6('net15')} AS net15, posseg, pass FROM res""")
def _sliced(spark, sf):
    return G.monthly_eval_sliced(bars(spark, sf, "1h"), B.month_windows(spark, START, END), IDS, 5, 0.5, bound(spark, sf, "1h")).select(
        *BY.split(", "), "month", "n", "net", "dd", "net15", "posseg", "pass")


@check("monthly_eval_stream", f"""WITH {walk('1h')}, {signal_cte()}, {trade_cte()}, tm AS (SELECT *, strftime(make_timestamp(entry_t * 1000), '%Y-%m') AS month FROM tr),
{result_cte('tm', BY + ', month', str(START), str(END), '5', clamp=True)}, cv AS (SELECT symbol, least(1.0, count(*) / (({END} - {START}) // 3600000)) AS coverage FROM bars GROUP BY 1)
SELECT r.symbol, timeframe, strategy_id, month, {r6('coverage')} AS coverage, coverage >= 0.5 AS eligible, n, {r6('net')} AS net, {r6('net15')} AS net15, {r6('pf')} AS pf, {r6('dd')} AS dd, {r6('exp')} AS exp, posseg, pass FROM res r JOIN cv ON cv.symbol = r.symbol""")
def _stream(spark, sf):
    b = bars(spark, sf, "1h")
    covered = G.month_coverage(b, B.month_windows(spark, START, END))
    t = trade_table(spark, sf, timeframe="1h")
    return G.monthly_eval_stream(t, covered, t.select(*BY.split(", ")).distinct(), 5, 0.5)


# --- variants -----------------------------------------------------------------------------

GRID = {"lookback": [12, 24], "thresholdAtr": [0.03, 0.08], "bodyConfirm": [False, True], "wickRatio": [0.0, 1.5]}


def variant_table(spark):
    return G.build_variants(spark, GRID, {"lookback": 24, "thresholdAtr": 0.05})


def _var_rows() -> str:
    out = [(p, t, b, w, False) for p in (12, 24) for t in (0.03, 0.08) for b in (False, True) for w in (0.0, 1.5)] + [(24, 0.05, False, 0.0, True)]
    txt = lambda x: str(int(x)) if float(x).is_integer() else str(x)
    ids = [f"range_reclaim__p{p}__t{txt(t)}__b{int(b)}__w{txt(w)}__r0__dboth".replace(".", "p") for p, t, b, w, _ in out]
    return ", ".join(f"('{i}', {p}, {t}, {b}, {w}, {base})".lower().replace("dboth", "dboth") for i, (p, t, b, w, base) in zip(ids, out))


VARIANTS = f"""vr AS (SELECT vid, lb, CAST(th AS DOUBLE) AS th, bc, CAST(wr AS DOUBLE) AS wr, base FROM (VALUES {_var_rows()}) v(vid, lb, th, bc, wr, base))"""
VARIANT_SIGNALS = f"""{S.LAGS}, {S.ATR}, lr AS (SELECT *, {S.ranges((12, 24))}, lead(t) OVER {S.W} AS nt, lead(o) OVER {S.W} AS no FROM xa), {VARIANTS},
vs AS (SELECT l0.*, vid AS strategy_id, CASE WHEN l < lo - th * a AND c > lo AND (NOT bc OR c > o) AND (wr <= 0 OR {S.LW} > wr * greatest({S.BODY}, 0.02 * a)) THEN 1
  WHEN h > hi + th * a AND c < hi AND (NOT bc OR c < o) AND (wr <= 0 OR {S.UW} > wr * greatest({S.BODY}, 0.02 * a)) THEN -1 ELSE 0 END AS sig
  FROM (SELECT *, unnest([{{'lb': 12, 'hi': ph12, 'lo': pl12}}, {{'lb': 24, 'hi': ph24, 'lo': pl24}}]) AS z FROM lr WHERE a > 0) l0, LATERAL (SELECT z.hi AS hi, z.lo AS lo) q JOIN vr ON vr.lb = l0.z.lb),
sg AS MATERIALIZED (SELECT symbol, timeframe, strategy_id, i, t, nt, no, sig FROM vs WHERE sig <> 0)"""


def variant_signals(spark, sf):
    return range_reclaim(bars(spark, sf), variant_table(spark), [12, 24], longest=bound(spark, sf))


@check("range_reclaim_variants", f"WITH RECURSIVE {walk()}, {VARIANT_SIGNALS} SELECT symbol, strategy_id, t, sig FROM sg")
def _variants(spark, sf):
    return variant_signals(spark, sf).select("symbol", "strategy_id", "t", "sig")


@check("variant_months", f"""WITH RECURSIVE {walk()}, {VARIANT_SIGNALS}, {trade_cte()}, {result_cte('tr', BY, str(START), str(END), '5', clamp=True)}
SELECT symbol, strategy_id AS "variantId", base AS baseline, n, {r6('net')} AS net, {r6('dd')} AS dd, pass FROM res JOIN vr ON vid = strategy_id""")
def _variant_months(spark, sf):
    t = T.trades(variant_signals(spark, sf), T.last_bars(bars(spark, sf)))
    rows = T.evaluate(t, F.lit(START), F.lit(END), least=F.lit(5), clamp_low=True).withColumnRenamed("strategy_id", "variantId")
    return rows.join(variant_table(spark).select("variantId", "baseline"), "variantId").select("symbol", "variantId", "baseline", "n", "net", "dd", "pass")


RECOVERY = f"""{MONTHS}, vm AS (SELECT symbol, timeframe, strategy_id AS vid, month, eligible, pass OR (symbol IN ('C1', 'C4') AND strategy_id <> 's0') OR (month <> '1995-03' AND symbol IN ('C1', 'C3', 'C4', 'C6')) AS pass FROM mo WHERE month < '1996-01'),
bs AS (SELECT symbol, month, eligible AND pass AS bp, eligible AS be FROM vm WHERE vid = 's0'),
hr AS (SELECT *, row_number() OVER (PARTITION BY symbol, vid ORDER BY eligible DESC, month DESC) <= 3 AND eligible AS ho FROM vm),
sm AS (SELECT h.symbol, h.timeframe, vid, vid = 's0' AS baseline, count(*) FILTER (eligible) AS e, count(*) FILTER (eligible AND pass) AS p, count(*) FILTER (ho) AS hm, count(*) FILTER (ho AND pass) AS hp,
  max(bp::INT) IS NOT NULL AS has, sum(bp::INT) AS bpm, sum(be::INT) AS bem, coalesce(bool_and(NOT bp OR pass), false) AS keeps FROM hr h LEFT JOIN bs ON bs.symbol = h.symbol AND bs.month = h.month GROUP BY 1, 2, 3, 4)"""


@check("recovery_annotations", f"""WITH {RECOVERY} SELECT symbol, timeframe, vid AS "variantId", e AS eligible_months, p AS pass_months, CAST(p - bpm AS BIGINT) AS delta_pass_months, keeps AS preserves,
  CASE WHEN NOT has THEN 'NO_BASELINE' WHEN baseline THEN CASE WHEN bem >= 2 AND bpm = bem - 1 THEN 'BASELINE_NEAR_PASS' ELSE 'BASELINE' END
  WHEN bem >= 2 AND bpm = bem - 1 AND e > 0 AND p = e AND keeps THEN CASE WHEN hp = hm THEN 'VALIDATED_RECOVERY' ELSE 'RECOVERY_CANDIDATE' END WHEN e > 0 AND p = e THEN 'FULL_PASS' ELSE 'OTHER' END AS recovery_status FROM sm""")
def _recovery(spark, sf):
    m = month_rows(spark, sf).where("month < '1996-01'")
    fixed = F.col("pass") | (F.col("symbol").isin("C1", "C4") & (F.col("strategy_id") != "s0")) | (
        (F.col("month") != "1995-03") & F.col("symbol").isin("C1", "C3", "C4", "C6"))
    rows = m.select("symbol", "timeframe", F.col("strategy_id").alias("variantId"), "month", "eligible", fixed.alias("pass"))
    names = rows.select("variantId").distinct().withColumn("baseline", F.col("variantId") == "s0")
    return G.annotate_recovery(rows, names, 3).select("symbol", "timeframe", "variantId", "eligible_months", "pass_months", "delta_pass_months", "preserves", "recovery_status")


# Seven years of daily bars from line items; one symbol is listed late, in the middle of a month.
DAY_START, DAY_END, LATE = 694_224_000_000, 915_148_800_000, "1995-03-17"
DAILY = f"""bars AS MATERIALIZED (SELECT symbol, '1d' AS timeframe, t, o, h, l, c, v, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM (
  SELECT 'S' || l_suppkey % 5 AS symbol, epoch_ms(l_shipdate) AS t, first(CAST(l_extendedprice AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS o, CAST(max(l_extendedprice) AS DOUBLE) AS h,
    CAST(min(l_extendedprice) AS DOUBLE) AS l, last(CAST(l_extendedprice AS DOUBLE) ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS c, CAST(count(*) AS DOUBLE) AS v
  FROM lineitem WHERE l_shipdate IS NOT NULL AND NOT (l_suppkey % 5 = 4 AND l_shipdate < DATE '{LATE}') GROUP BY 1, 2))"""


def daily_bars(spark, sf):
    price, order = F.col("l_extendedprice").cast("double"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    rows = table(spark, sf, "lineitem").where(f"l_shipdate IS NOT NULL AND NOT (l_suppkey % 5 = 4 AND l_shipdate < DATE '{LATE}')")
    return rows.groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")).alias("symbol"), F.lit("1d").alias("timeframe"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t")).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"), F.count("*").cast("double").alias("v"))


@check("prior_month_sweeps_daily", f"SELECT * FROM ({S.CALENDAR_SQL.replace(walk(), DAILY)}) WHERE strategy_id = 'swp_prior_month'")
def _prior_month(spark, sf):
    return signals(daily_bars(spark, sf), ["swp_prior_month"], (DAY_END - DAY_START) // 86_400_000).select("symbol", "timeframe", "strategy_id", "t", "sig")


@check("series_month_coverage", f"""WITH {DAILY}, r AS (SELECT * FROM bars WHERE t >= {DAY_START} AND t < {DAY_END}), a AS (SELECT symbol, min(t) AS a FROM r GROUP BY 1),
m AS (SELECT symbol, a, unnest(generate_series(date_trunc('month', make_timestamp(a * 1000)), make_timestamp({DAY_END - 1} * 1000), INTERVAL 1 MONTH)) AS d FROM a),
w AS (SELECT symbol, strftime(d, '%Y-%m') AS month, greatest(epoch_ms(d), a) AS start, least(epoch_ms(d + INTERVAL 1 MONTH), {DAY_END}) AS "end" FROM m),
n AS (SELECT symbol, strftime(make_timestamp(t * 1000), '%Y-%m') AS month, count(*) AS n FROM r GROUP BY 1, 2)
SELECT symbol, month, start, "end", coalesce(n, 0) AS rows, {r6('least(1, coalesce(n, 0) / greatest(1, floor(("end" - start) / 86400000)))')} AS coverage FROM w LEFT JOIN n USING (symbol, month)""")
def _series_months(spark, sf):
    b = daily_bars(spark, sf).where((F.col("t") >= DAY_START) & (F.col("t") < DAY_END))
    return G.month_coverage(b, B.series_months(b, DAY_START, DAY_END)).select("symbol", "month", "start", "end", "rows", "coverage")


CUTS = [1_704_672_000_000, 1_705_276_800_000, 1_705_881_600_000, 1_706_227_200_000, 1_706_486_400_000]


@check("causality_audit", f"""WITH {walk('1h')} SELECT symbol, timeframe, '' AS strategy_id, CAST(0 AS BIGINT) AS cut, t, CAST(0 AS BIGINT) AS sig, '' AS kind FROM bars WHERE t < 0""")
def _audit(spark, sf):
    ids = ["sr_break_retest", "sr25_lsob", "sr25_trendline_breakout", "swp_mss_confirm", "vis_hull_suite", "vis_macd_rsi", "ott", "fib_retrace_500"]
    return G.causality_audit(bars(spark, sf, "1h"), CUTS, ids, bound(spark, sf, "1h"))


def causality_sql() -> str:
    """What each of the 101 strategies signals up to each cut; a prefix that sees nothing ahead has just these."""
    from checks.strategies import GROUPS

    groups = " UNION ALL ".join(f"SELECT symbol, timeframe, strategy_id, t, sig FROM ({sql})" for _, sql in GROUPS.values())
    cuts = ", ".join(f"({c})" for c in CUTS)
    return f"""WITH {walk()}, sa AS MATERIALIZED ({groups}) SELECT strategy_id, CAST(cut AS BIGINT) AS cut, count(*) AS n, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS extra
FROM sa JOIN (VALUES {cuts}) c(cut) ON t <= cut GROUP BY 1, 2"""


@check("causality_counts", causality_sql())
def _audit_counts(spark, sf):
    return G.causality_counts(bars(spark, sf), CUTS, None, bound(spark, sf))
