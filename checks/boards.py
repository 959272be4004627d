"""Rankings and tradability over result rows made from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.plans import boards as P
from barlight.sources.files import pending_keys
from checks.base import check, r6, table

# One result row per symbol, strategy and timeframe: parts stand for contracts, suppliers for strategies.
RESULTS = """rr AS MATERIALIZED (SELECT *, CASE timeframe WHEN '5m' THEN 30 WHEN '1h' THEN 20 WHEN '4h' THEN 10 ELSE 3 END AS min_trades,
    n >= CASE timeframe WHEN '5m' THEN 30 WHEN '1h' THEN 20 WHEN '4h' THEN 10 ELSE 3 END AND net > 0 AND exp > 0 AND pf > 1.05 AND posseg >= 2 AND net15 > 0 AS pass
  FROM (SELECT 'P' || (l_partkey % 600) || CASE WHEN l_linenumber % 2 = 0 THEN 'USDT' ELSE 'USDC' END AS symbol, CASE l_suppkey // 12 % 4 WHEN 0 THEN '5m' WHEN 1 THEN '1h' WHEN 2 THEN '4h' ELSE '1d' END AS timeframe,
    's' || (l_suppkey % 12) AS strategy_id, 'f' || (l_suppkey % 12 % 5) AS family, count(*) + CAST(max(l_quantity) AS BIGINT) AS n, floor(max(l_extendedprice)) / 60000 - 0.9 AS net, round(min(l_quantity) / 10 + 0.5, 4) AS pf,
    round(max(l_tax) * 6, 4) AS dd, round(max(l_discount) - 0.02, 4) AS exp, CAST(min(l_linenumber) % 4 AS BIGINT) AS posseg, floor(max(l_extendedprice)) / 60000 - 0.91 AS net15, round(1 - min(l_tax), 4) AS coverage
    FROM lineitem GROUP BY 1, 2, 3, 4)),
bd AS MATERIALIZED (SELECT *, regexp_replace(symbol, '(USDT|USDC)$', '') AS underlying, n >= least(5, min_trades) AND net > 0 AND exp > 0 AND pf > 1 AND net15 > 0 AS rankable,
  concat_ws(',', CASE WHEN n < min_trades THEN 'LOW_SAMPLE' END, CASE WHEN NOT pass THEN 'NOT_EVIDENCE_PASS' END, CASE WHEN dd > 0.45 THEN 'HIGH_DD' END, CASE WHEN net > 5 THEN 'EXTREME_COMPOUNDING' END,
    CASE WHEN pf > 8 THEN 'EXTREME_PF' END, CASE WHEN posseg < 2 THEN 'UNSTABLE_SEGMENTS' END, CASE WHEN coverage < 0.95 THEN 'PARTIAL_COVERAGE' END) AS flags FROM rr)"""


def results(spark, sf):
    li = table(spark, sf, "lineitem")
    k, s, ln = F.col("l_partkey") % 600, F.col("l_suppkey"), F.col("l_linenumber")
    q = F.floor(s / 12) % 4
    symbol = F.concat(F.lit("P"), k.cast("string"), F.when(ln % 2 == 0, "USDT").otherwise("USDC"))
    tf = F.when(q == 0, "5m").when(q == 1, "1h").when(q == 2, "4h").otherwise("1d")
    price = F.floor(F.max("l_extendedprice")) / 60000
    rows = li.groupBy(symbol.alias("symbol"), tf.alias("timeframe"), F.concat(F.lit("s"), (s % 12).cast("string")).alias("strategy_id"),
                      F.concat(F.lit("f"), (s % 12 % 5).cast("string")).alias("family")).agg(
        (F.count("*") + F.max("l_quantity").cast("bigint")).alias("n"), (price - 0.9).alias("net"), F.round(F.min("l_quantity") / 10 + 0.5, 4).alias("pf"),
        F.round(F.max("l_tax") * 6, 4).alias("dd"), F.round(F.max("l_discount") - 0.02, 4).alias("exp"), (F.min(ln) % 4).cast("bigint").alias("posseg"),
        (price - 0.91).alias("net15"), F.round(1 - F.min("l_tax"), 4).alias("coverage"))
    least = F.when(F.col("timeframe") == "5m", 30).when(F.col("timeframe") == "1h", 20).when(F.col("timeframe") == "4h", 10).otherwise(3)
    ok = (F.col("n") >= F.col("min_trades")) & (F.col("net") > 0) & (F.col("exp") > 0) & (F.col("pf") > 1.05) & (F.col("posseg") >= 2) & (F.col("net15") > 0)
    return rows.withColumn("min_trades", least).withColumn("pass", ok)


def board(spark, sf):
    return P.prepared(results(spark, sf))


ID = ("symbol", "strategy_id", "timeframe")


@check("review_flags", f"WITH {RESULTS} SELECT symbol, strategy_id, timeframe, rankable, pass, underlying, flags FROM bd")
def _flags(spark, sf):
    return board(spark, sf).select(*ID, "rankable", "pass", "underlying", "flags")


@check("top_per_strategy", f"WITH {RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, timeframe ORDER BY net DESC, symbol) AS rank FROM bd WHERE rankable) SELECT strategy_id, timeframe, rank, symbol, {r6('net')} AS net FROM k WHERE rank <= 5")
def _top(spark, sf):
    return P.top_per_group(board(spark, sf)).select("strategy_id", "timeframe", "rank", "symbol", "net")


@check("top_per_underlying", f"""WITH {RESULTS}, o AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, timeframe, underlying ORDER BY net DESC, symbol) AS b FROM bd WHERE rankable),
k AS (SELECT *, row_number() OVER (PARTITION BY strategy_id, timeframe ORDER BY net DESC, symbol) AS rank FROM o WHERE b = 1) SELECT strategy_id, timeframe, rank, underlying, symbol FROM k WHERE rank <= 5""")
def _top_under(spark, sf):
    return P.top_per_underlying(board(spark, sf)).select("strategy_id", "timeframe", "rank", "underlying", "symbol")


@check("coin_cards", f"WITH {RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, strategy_id, timeframe) AS rank FROM bd WHERE rankable) SELECT symbol, rank, strategy_id, timeframe, {r6('net')} AS net FROM k WHERE rank <= 5")
def _cards(spark, sf):
    return P.coin_cards(board(spark, sf)).select("symbol", "rank", "strategy_id", "timeframe", "net")


@check("global_top", f"WITH {RESULTS} SELECT symbol, strategy_id, timeframe, {r6('net')} AS net FROM bd WHERE rankable ORDER BY net DESC, symbol, strategy_id, timeframe LIMIT 100")
def _global(spark, sf):
    return P.global_top(board(spark, sf)).select(*ID, "net")


@check("consensus", f"""WITH {RESULTS} SELECT symbol, count(DISTINCT family) AS families, count(*) AS combinations, count(*) FILTER (pass) AS evidence, {r6('max(net)')} AS best_net,
  array_to_string(list_sort(list(DISTINCT strategy_id)), ',') AS strategies FROM bd WHERE rankable GROUP BY 1 HAVING count(DISTINCT family) >= 2""")
def _consensus(spark, sf):
    return P.consensus(board(spark, sf))


def _mid(c: str) -> str:
    return f"{r6(f'median({c})')} AS median_{'trades' if c == 'n' else c}"


@check("strategy_summary", f"""WITH {RESULTS} SELECT strategy_id, count(*) AS tested, count(*) FILTER (pass) AS passes, {r6('count(*) FILTER (pass) / count(*)')} AS pass_rate, count(*) FILTER (net > 0) AS positive,
  {r6('count(*) FILTER (net > 0) / count(*)')} AS positive_rate, {', '.join(_mid(c) for c in ('net', 'pf', 'dd', 'n'))} FROM rr GROUP BY 1""")
def _summary(spark, sf):
    return P.strategy_summary(results(spark, sf))


@check("strategy_summary_upper", f"""WITH {RESULTS} SELECT strategy_id, {', '.join(f"{r6(f'list_sort(list({c}))[count(*) // 2 + 1]')} AS median_{c}" for c in ('net', 'pf', 'dd'))} FROM rr GROUP BY 1""")
def _summary_upper(spark, sf):
    return P.strategy_summary(results(spark, sf), upper_middle=True).select("strategy_id", "median_net", "median_pf", "median_dd")


@check("multi_strategy_symbols", f"WITH {RESULTS} SELECT symbol, count(*) AS passing, array_to_string(list_sort(list(strategy_id)), ',') AS strategies, {r6('max(net)')} AS best_net FROM rr WHERE pass GROUP BY 1")
def _multi(spark, sf):
    return P.multi_strategy_symbols(results(spark, sf))


def matrix_sql(src: str, key: str) -> str:
    def best(on: str, k: int) -> str:
        return (f"array_to_string(list_slice(coalesce(list(symbol || ':' || strategy_id || ':' || timeframe ORDER BY net DESC, symbol, strategy_id, timeframe) FILTER ({on}), []), 1, {k}), ',')")
    cl = "pass AND dd <= 0.40 AND pf >= 1.20 AND net > 0.10"
    return f"""SELECT {key}, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS contracts, count(*) FILTER (pass) AS evidence, count(DISTINCT timeframe) FILTER (pass) AS timeframes,
  count(DISTINCT strategy_id) FILTER (pass) AS strategies, count(DISTINCT family) FILTER (pass) AS families, count(*) FILTER ({cl}) AS clean, {r6('max(net)')} AS best_net, {r6('max(net) FILTER (pass)')} AS best_evidence_net,
  {r6('median(net) FILTER (pass)')} AS median_net, {r6('median(dd) FILTER (pass)')} AS median_dd, {r6('max(dd) FILTER (pass)')} AS max_dd, {best(cl, 5)} AS best_clean, {best('true', 8)} AS all_top FROM {src} GROUP BY 1"""


@check("contract_matrix", f"WITH {RESULTS} {matrix_sql('(SELECT * FROM bd WHERE rankable)', 'symbol')}")
def _contracts(spark, sf):
    return P.contract_matrix(board(spark, sf))


UNDER = f"""{RESULTS}, rk AS (SELECT * FROM bd WHERE rankable), ra AS (SELECT *, row_number() OVER (PARTITION BY underlying, strategy_id, timeframe ORDER BY net DESC, symbol DESC) AS k FROM rk),
pa AS (SELECT *, row_number() OVER (PARTITION BY underlying, strategy_id, timeframe ORDER BY net DESC, symbol DESC) AS k FROM rk WHERE pass),
wa AS ({matrix_sql('(SELECT * FROM ra WHERE k = 1)', 'underlying')}), wp AS ({matrix_sql('(SELECT * FROM pa WHERE k = 1)', 'underlying')}),
um AS MATERIALIZED (SELECT n.underlying, n.contracts, wa.best_net, wa.all_top, coalesce(wp.evidence, 0) AS evidence, coalesce(wp.timeframes, 0) AS timeframes, coalesce(wp.strategies, 0) AS strategies, coalesce(wp.families, 0) AS families,
  coalesce(wp.clean, 0) AS clean, wp.best_evidence_net, wp.median_net, wp.median_dd, wp.max_dd, wp.best_clean FROM (SELECT underlying, array_to_string(list_sort(list(DISTINCT symbol)), ',') AS contracts FROM rk GROUP BY 1) n
  JOIN wa USING (underlying) LEFT JOIN wp USING (underlying))"""


@check("underlying_matrix", f"WITH {UNDER} SELECT * FROM um")
def _underlying(spark, sf):
    return P.underlying_matrix(board(spark, sf))


M_COLS = ("underlying", "timeframes", "families", "clean", "best_evidence_net")


@check("management_watchlist", f"WITH {UNDER} SELECT {', '.join(M_COLS)} FROM um WHERE timeframes >= 2 AND families >= 2 AND clean >= 2 ORDER BY timeframes DESC, families DESC, clean DESC, best_evidence_net DESC, underlying LIMIT 50")
def _management(spark, sf):
    return P.management_watchlist(P.underlying_matrix(board(spark, sf))).select(*M_COLS)


@check("deployment_candidates", f"WITH {UNDER} SELECT {', '.join(M_COLS)} FROM um WHERE timeframes >= 3 AND families >= 2 AND clean >= 4 AND median_dd <= 0.35 ORDER BY clean DESC, timeframes DESC, families DESC, best_evidence_net DESC, underlying LIMIT 50")
def _deployment(spark, sf):
    return P.deployment_candidates(P.underlying_matrix(board(spark, sf))).select(*M_COLS)


@check("high_profit_review", f"WITH {RESULTS} SELECT symbol, strategy_id, timeframe, {r6('net')} AS net, flags FROM bd WHERE rankable AND flags <> '' ORDER BY net DESC, symbol, strategy_id, timeframe LIMIT 100")
def _high(spark, sf):
    return P.high_profit_review(board(spark, sf)).select(*ID, "net", "flags")


@check("timeframe_summary", f"WITH {RESULTS} SELECT timeframe, count(DISTINCT symbol) AS symbols, count(*) AS combinations, count(*) FILTER (pass) AS evidence, count(*) FILTER (rankable) AS rankable FROM bd GROUP BY 1")
def _tf(spark, sf):
    return P.timeframe_summary(board(spark, sf))


@check("pending_result_keys", f"WITH {RESULTS} SELECT symbol, strategy_id, timeframe FROM rr WHERE NOT pass")
def _pending(spark, sf):
    r = results(spark, sf)
    return pending_keys(r.select(*ID), r.where("pass"), list(ID))


# Contracts with market data: customers, in two quote currencies.
SNAP = """sn AS MATERIALIZED (SELECT 'U' || (c_custkey % 400) || CASE WHEN c_custkey % 3 = 0 THEN 'USDC' WHEN c_custkey % 3 = 1 THEN 'USDT' ELSE 'BUSD' END AS symbol, max(round((c_acctbal + 1000) * 4000, 2)) AS volume, min(round(c_custkey % 29 / 1.0, 2)) AS spread,
  max(round((c_acctbal + 999) * 1.7, 2)) AS bd10, max(round((c_acctbal + 999) * 1.3, 2)) AS ad10, max(round((c_acctbal + 999) * 2500, 2)) AS oi FROM customer GROUP BY 1)"""
STATUS = """st AS MATERIALIZED (SELECT *, least(bd10, ad10) AS depth, CASE WHEN spread > 25 OR volume < 500000 OR least(bd10, ad10) < 250 OR oi < 500000 THEN 'BLOCK'
    WHEN volume >= 20000000 AND spread <= 3 AND least(bd10, ad10) >= 10000 AND oi >= 10000000 THEN 'STRONG' WHEN volume >= 3000000 AND spread <= 8 AND least(bd10, ad10) >= 1000 AND oi >= 2000000 THEN 'TRADEABLE' ELSE 'REVIEW' END AS status,
  concat_ws(',', CASE WHEN spread > 25 THEN 'SPREAD_HARD' END, CASE WHEN volume < 500000 THEN 'QUOTE_VOLUME_HARD' END, CASE WHEN least(bd10, ad10) < 250 THEN 'MIN_DEPTH_10BPS' END, CASE WHEN oi < 500000 THEN 'OPEN_INTEREST_HARD' END) AS reasons FROM sn)"""


def snapshot(spark, sf):
    c, k, b = table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    quote = F.when(k % 3 == 0, "USDC").when(k % 3 == 1, "USDT").otherwise("BUSD")
    return c.groupBy(F.concat(F.lit("U"), (k % 400).cast("string"), quote).alias("symbol")).agg(
        F.max(F.round((b + 1000) * 4000, 2)).alias("quoteVolume24h"), F.min((k % 29).cast("double")).alias("spreadBps"), F.max(F.round((b + 999) * 1.7, 2)).alias("bidDepth10bps"),
        F.max(F.round((b + 999) * 1.3, 2)).alias("askDepth10bps"), F.max(F.round((b + 999) * 2500, 2)).alias("openInterestNotional"))


@check("tradability", f"WITH {SNAP}, {STATUS} SELECT symbol, status, reasons FROM st")
def _tradability(spark, sf):
    return P.with_tradability(snapshot(spark, sf)).select("symbol", "status", "reasons")


@check("tradability_depth_advisory", f"WITH {SNAP}, {STATUS} SELECT symbol, CASE WHEN reasons = 'MIN_DEPTH_10BPS' THEN 'REVIEW' ELSE status END AS status FROM st")
def _advisory(spark, sf):
    return P.with_tradability(snapshot(spark, sf), True).select("symbol", "status")


@check("execution_watchlist", f"""WITH {SNAP}, {STATUS}, cd AS (SELECT 'U' || u AS underlying, unnest(['USDT', 'USDC']) AS q FROM (SELECT DISTINCT c_custkey % 450 AS u FROM customer)),
j AS (SELECT underlying, underlying || q AS contract, st.* FROM cd LEFT JOIN st ON st.symbol = underlying || q),
k AS (SELECT *, CASE status WHEN 'STRONG' THEN 3 WHEN 'TRADEABLE' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END AS r, row_number() OVER (PARTITION BY underlying ORDER BY symbol IS NULL,
  CASE status WHEN 'STRONG' THEN 3 WHEN 'TRADEABLE' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END DESC, depth DESC, volume DESC, spread, contract) AS n FROM j)
SELECT underlying, coalesce(max(symbol) FILTER (n = 1), underlying || 'USDT') AS contract, coalesce(max(status) FILTER (n = 1), 'NO_MARKET_SNAPSHOT') AS status, coalesce(max(reasons) FILTER (n = 1), '') AS reasons,
  coalesce(string_agg(contract || ':' || status, ',' ORDER BY n) FILTER (n > 1 AND symbol IS NOT NULL), '') AS alternatives FROM k GROUP BY 1""")
def _watchlist(spark, sf):
    u = table(spark, sf, "customer").select(F.concat(F.lit("U"), (F.col("c_custkey") % 450).cast("string")).alias("underlying")).distinct()
    cand = u.withColumn("contracts", F.array(F.concat("underlying", F.lit("USDT")), F.concat("underlying", F.lit("USDC"))))
    return P.execution_watchlist(cand, snapshot(spark, sf))
