"""Sources, resampling, quality, coverage and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import bars as B
from barlight.plans import boards as P
from barlight.sources.files import normalize_columns, universe
from barlight.sources.ticks import ticks_to_bars
from checks.base import bars, check, r6, sql_bars, sql_ticks, table, ticks, walk

OUT = "symbol, timeframe, t, o, h, l, c, v"
START, END = 1_704_067_200_000, 1_706_659_200_000  # 2024-01-01 and 2024-01-31, UTC
PARTIAL_START = 1_704_240_000_000


@check("walk_bars", f"WITH {walk('15m')} SELECT {OUT} FROM bars")
def _walk(spark, sf):
    return bars(spark, sf)


@check("resample_bars", f"WITH {walk('1m')}, agg AS (SELECT symbol, '1h' AS timeframe, t // 3600000 * 3600000 AS t, arg_min(o, t) AS o, "
       f"max(h) AS h, min(l) AS l, arg_max(c, t) AS c, sum(v) AS v FROM bars GROUP BY 1, 2, 3) SELECT {OUT} FROM agg")
def _resample(spark, sf):
    return B.resample(bars(spark, sf, "1m"), "1h")


@check("resample_many_timeframes", f"WITH {sql_ticks()}, " + ", ".join(sql_bars(tf, f"b{tf}") for tf in ("5m", "15m", "1h", "4h"))
       + " " + " UNION ALL ".join(f"SELECT {OUT} FROM b{tf}" for tf in ("5m", "15m", "1h", "4h")))
def _many(spark, sf):
    return B.resample_many(bars(spark, sf, "1m"), ["5m", "15m", "1h", "4h"])


def _calendar_sql(unit: str, name: str, step: str) -> str:
    return (f"SELECT symbol, '{name}' AS timeframe, epoch_ms(s) AS t, o, h, l, c, v, epoch_ms(s + INTERVAL {step}) AS close_t FROM (SELECT symbol, "
            f"date_trunc('{unit}', make_timestamp(t * 1000)) AS s, arg_min(o, t) AS o, max(h) AS h, min(l) AS l, arg_max(c, t) AS c, sum(v) AS v FROM bars GROUP BY 1, 2)")


@check("resample_calendar", f"WITH {walk('1h')} " + " UNION ALL ".join(
    _calendar_sql(*x) for x in (("day", "1d", "1 DAY"), ("week", "1w", "7 DAY"), ("month", "1M", "1 MONTH"))))
def _calendar(spark, sf):
    base = bars(spark, sf, B.base_timeframe(["1m", "15m", "1h"], 86_400_000))
    d, w, m = (B.resample_calendar(base, u) for u in ("day", "week", "month"))
    return d.unionByName(w).unionByName(m)


@check("tick_bars", """SELECT event_type AS symbol, epoch_us(ts) // 3600000000 * 3600000 AS t, first(value ORDER BY ts, event_id) AS o, max(value) AS h,
  min(value) AS l, last(value ORDER BY ts, event_id) AS c, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2""")
def _ticks(spark, sf):
    rows = ticks(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tie"),
                                   F.col("value").alias("price"), F.lit(1.0).alias("size"))
    return ticks_to_bars(rows, 3_600_000)


@check("columnar_bars", """SELECT o_orderpriority AS symbol, '1d' AS timeframe, epoch_ms(o_orderdate) AS t, o_totalprice AS o, o_totalprice AS h, o_totalprice AS l,
  o_totalprice AS c, CAST(o_custkey AS DOUBLE) AS v FROM orders""")
def _columnar(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("Symbol"), F.col("o_orderdate").alias("Date"),
        *[F.col("o_totalprice").alias(n) for n in ("Open", "HIGH", "low", "Close")], F.col("o_custkey").alias("Volume"))
    return normalize_columns(raw, "1d")


@check("epoch_units", """SELECT event_type AS symbol, '1m' AS timeframe, epoch_us(ts) // 1000 AS t, value AS o, value AS h, value AS l, value AS c,
  CAST(user_id AS DOUBLE) AS v FROM events""")
def _units(spark, sf):
    # The same events in micro- and nanoseconds end as the same milliseconds.
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = ticks(spark, sf).select(
        F.col("event_type").alias("symbol"), F.when(F.col("event_type").isin("click", "view"), us * 1000).otherwise(us).alias("time"),
        *[F.col("value").alias(n) for n in ("o", "h", "l", "c")], F.col("user_id").alias("v"))
    return normalize_columns(raw, "1m")


@check("merged_bars", f"""WITH {walk('1h')},
u AS (SELECT *, 0 AS rk FROM bars UNION ALL SELECT symbol, timeframe, t, o + 1, h + 1, l + 1, c + 1, v, i, 1 FROM bars WHERE t >= {PARTIAL_START}),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, t ORDER BY rk DESC) AS n FROM u WHERE t < {END - 86_400_000}) SELECT {OUT} FROM k WHERE n = 1""")
def _merge(spark, sf):
    now = bars(spark, sf, "1h")
    new = now.where(F.col("t") >= PARTIAL_START).withColumns({x: F.col(x) + 1 for x in ("o", "h", "l", "c")})
    return B.merge_bars(now, new, end=END - 86_400_000)


GAP_START, GAP_END = 1_698_796_800_000, 1_707_004_800_000  # 2023-11-01, 2024-02-04


@check("archive_gap_plan", f"""WITH e AS (SELECT event_type AS symbol, min(epoch_us(ts)) // 60000000 * 60000 AS a, max(epoch_us(ts)) // 60000000 * 60000 AS b FROM events GROUP BY 1)
SELECT symbol, 'month' AS kind, strftime(d, '%Y-%m') AS period FROM (SELECT symbol, unnest(generate_series(date_trunc('month', make_timestamp({GAP_START} * 1000)),
  date_trunc('month', make_timestamp(a * 1000)), INTERVAL 1 MONTH)) AS d FROM e WHERE a > {GAP_START})
UNION ALL SELECT symbol, 'day', strftime(d, '%Y-%m-%d') FROM (SELECT symbol, unnest(generate_series(date_trunc('day', make_timestamp(b * 1000)),
  date_trunc('day', make_timestamp({GAP_END - 1} * 1000)), INTERVAL 1 DAY)) AS d FROM e WHERE b < {GAP_END - 60000})""")
def _gaps(spark, sf):
    return B.archive_gap_plan(bars(spark, sf, "1m"), GAP_START, GAP_END)


@check("universe_scan", "SELECT DISTINCT event_type AS symbol FROM events")
def _universe(spark, sf):
    return universe(bars(spark, sf, "1m"), least=5)


DIRTY = """raw AS (SELECT event_type AS symbol, 'tick' AS timeframe, event_id AS seq, epoch_us(ts) // 60000000 * 60000 AS t, value AS o, value + user_id % 3 AS h,
  value - user_id % 2 + CASE WHEN event_id % 97 = 0 THEN 5 ELSE 0 END AS l, value AS c, CASE WHEN event_id % 89 = 0 THEN -1.0 ELSE CAST(user_id AS DOUBLE) END AS v FROM events)"""


def _dirty(spark, sf):
    v, u, e = F.col("value"), F.col("user_id"), F.col("event_id")
    return ticks(spark, sf).select(
        F.col("event_type").alias("symbol"), F.lit("tick").alias("timeframe"), e.alias("seq"),
        (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60_000) * 60_000).cast("long").alias("t"), v.alias("o"), (v + u % 3).alias("h"),
        (v - u % 2 + F.when(e % 97 == 0, 5).otherwise(0)).alias("l"), v.alias("c"), F.when(e % 89 == 0, -1.0).otherwise(u.cast("double")).alias("v"))


BAD = "(h < l OR h < greatest(o, c) OR l > least(o, c))"


@check("quality_report", f"""WITH {DIRTY}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY seq) AS delta FROM raw),
m AS (SELECT symbol, delta AS interval_ms FROM (SELECT symbol, delta, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, delta) AS k FROM d WHERE delta > 0 GROUP BY 1, 2) WHERE k = 1)
SELECT d.symbol, timeframe, count(*) AS candles, arg_min(t, seq) AS first_t, arg_max(t, seq) AS last_t, count(*) FILTER (delta = 0) AS duplicates,
  count(*) FILTER (delta <= 0) AS non_increasing, count(*) FILTER ({BAD}) AS invalid_ohlc, count(*) FILTER (v < 0) AS negative_volume,
  max(interval_ms) AS interval, count(*) FILTER (delta > 0 AND delta / interval_ms > 1.5) AS gaps,
  {r6('greatest(1.0, max(CASE WHEN delta > 0 THEN delta / interval_ms END))')} AS largest_gap,
  count(*) FILTER (delta <= 0) + count(*) FILTER ({BAD}) + count(*) FILTER (v < 0) + count(*) FILTER (delta > 0 AND delta / interval_ms > 1.5) = 0 AS pass
FROM d JOIN m ON m.symbol = d.symbol GROUP BY 1, 2""")
def _quality(spark, sf):
    return B.quality_report(_dirty(spark, sf))


@check("validated_bars", f"""WITH {DIRTY}, d AS (SELECT *, lag(t) OVER (PARTITION BY symbol ORDER BY seq) AS pt FROM raw)
SELECT symbol, CASE WHEN v < 0 THEN 'NEGATIVE_VOLUME' WHEN {BAD} THEN 'INVALID_OHLC' WHEN t <= pt THEN 'NOT_INCREASING' ELSE 'VALID' END AS reason, count(*) AS n FROM d GROUP BY 1, 2""")
def _validated(spark, sf):
    good, bad = B.validate_bars(_dirty(spark, sf), "seq")
    return good.withColumn("reason", F.lit("VALID")).select("symbol", "reason").unionByName(bad.select("symbol", "reason")).groupBy(
        "symbol", "reason").agg(F.count("*").alias("n"))


AS_OF = 1_706_572_800_000


@check("candle_barrier", f"""WITH {walk('1h')}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS dt FROM bars)
SELECT symbol, timeframe, count(*) AS bars, max(t) AS last_t, {(AS_OF - 3000) // 3_600_000 * 3_600_000 - 3_600_000} AS expected_t,
  CASE WHEN count(*) < 64 THEN 'TOO_FEW_BARS' WHEN bool_or(t % 3600000 <> 0) THEN 'MISALIGNED_BAR' WHEN max(t) + 3600000 > {AS_OF} THEN 'OPEN_BAR'
    WHEN bool_or(dt <= 0) THEN 'OUT_OF_ORDER' WHEN bool_or(dt <> 3600000) THEN 'MISSING_BAR'
    WHEN max(t) <> {(AS_OF - 3000) // 3_600_000 * 3_600_000 - 3_600_000} THEN 'STALE_DATA' ELSE 'OK' END AS verdict FROM d GROUP BY 1, 2""")
def _barrier(spark, sf):
    return B.candle_barrier(bars(spark, sf, "1h"), AS_OF, 3_600_000)


@check("closed_bars", f"WITH {walk('1h')} SELECT {OUT} FROM bars WHERE t + 3600000 <= {AS_OF}")
def _closed(spark, sf):
    return B.closed_only(bars(spark, sf, "1h"), AS_OF, 3_600_000)


@check("coverage_gate", f"""WITH {sql_ticks()}, {sql_bars('15m', 'b15')}, {sql_bars('1h', 'b60')}, u AS (SELECT *, 900000 AS ms FROM b15 UNION ALL SELECT *, 3600000 FROM b60),
s AS (SELECT symbol, timeframe, ms, count(*) AS rows, min(t) AS first_t, max(t) AS last_t FROM u WHERE t >= {PARTIAL_START} AND t < {END} GROUP BY 1, 2, 3),
g AS (SELECT *, greatest(1, ({END} - greatest({PARTIAL_START}, first_t)) // ms) AS expected, (last_t - first_t + ms) / 86400000 AS days FROM s)
SELECT symbol, timeframe, rows, first_t, last_t, expected, {r6('least(1.0, rows / expected)')} AS coverage, {r6('days')} AS history_days,
  CASE WHEN days < 25 THEN 'TOO_SHORT_HISTORY' WHEN least(1.0, rows / expected) < 0.98 THEN 'PARTIAL_LIFETIME_COVERAGE' ELSE 'OK' END AS verdict FROM g""")
def _coverage(spark, sf):
    many = B.resample_many(bars(spark, sf, "1m"), ["15m", "1h"])
    return B.coverage_gate(B.coverage(many, PARTIAL_START, END), min_days=25)


@check("series_passing_gate", f"""WITH {walk('1h')}, s AS (SELECT symbol, count(*) AS n, min(t) AS a FROM bars WHERE t >= {PARTIAL_START} AND t < {END} GROUP BY 1)
SELECT symbol, count(*) AS n FROM bars WHERE symbol IN (SELECT symbol FROM s WHERE n / greatest(1, ({END} - greatest({PARTIAL_START}, a)) // 3600000) >= 0.9) GROUP BY 1""")
def _passing(spark, sf):
    b = bars(spark, sf, "1h")
    gated = B.coverage_gate(B.coverage(b, PARTIAL_START, END), min_days=20, min_coverage=0.9)
    return B.passing_series(b, gated).groupBy("symbol").agg(F.count("*").alias("n"))


@check("month_slices", """WITH l AS (SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) AS t FROM lineitem),
s AS (SELECT symbol, strftime(make_timestamp(t * 1000), '%Y-%m') AS month, count(*) AS n, min(t) AS first_t FROM l
  WHERE t >= 820540800000 AND t < 946771200000 GROUP BY 1, 2) SELECT symbol, month, n, first_t, greatest(epoch_ms(strptime(month || '-01', '%Y-%m-%d')), 820540800000) AS start,
  least(epoch_ms(strptime(month || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH), 946771200000) AS "end" FROM s""")
def _months(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"))
    windows = B.month_windows(spark, 820_540_800_000, 946_771_200_000)
    return B.month_slices(rows, windows).groupBy("symbol", "month", "start", "end").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@check("walk_forward_windows", f"""WITH {walk('15m')}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY 1),
w AS (SELECT b.symbol, i, n, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS tr, greatest(greatest(1, CAST(floor(n * 0.6) AS BIGINT)) + 1, CAST(floor(n * 0.8) AS BIGINT)) AS va FROM bars b JOIN n ON n.symbol = b.symbol)
SELECT symbol, CASE WHEN i < tr THEN 'train' WHEN i < va THEN 'validation' ELSE 'holdout' END AS wf, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM w WHERE n >= 30 GROUP BY 1, 2""")
def _wf(spark, sf):
    return B.walk_forward_labels(bars(spark, sf)).groupBy("symbol", "wf").agg(
        F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))


# --- order books ------------------------------------------------------------------

LEVELS_SQL = """lv AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS qty, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
b AS (SELECT k, list({'price': 100.0 - n * 0.03125, 'qty': qty} ORDER BY n) AS bids, list({'price': 100.0 + n * 0.046875, 'qty': qty + s % 7} ORDER BY n) AS asks, sum(qty) AS oi FROM lv GROUP BY 1)"""


def books(spark, sf):
    """One book per order: its lines are the levels."""
    lv = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.max("l_quantity").alias("qty"), F.max("l_suppkey").alias("s"))
    n = F.col("n")
    side = lambda price, qty: F.transform(
        F.array_sort(F.collect_list(F.struct("n", price.alias("price"), qty.cast("double").alias("qty")))),
        lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return lv.groupBy("k").agg(side(100.0 - n * 0.03125, F.col("qty")).alias("bids"),
                               side(100.0 + n * 0.046875, F.col("qty") + F.col("s") % 7).alias("asks"), F.sum("qty").alias("openInterestBase"))


def _depth(levels: str, side: str, k: int) -> str:
    d = "mid - x.price" if side == "bid" else "x.price - mid"
    return f"coalesce(list_sum([x.price * x.qty FOR x IN {levels} IF ({d}) / mid * 10000 <= {k}]), 0)"


@check("market_metrics", f"""WITH {LEVELS_SQL}, m AS (SELECT *, bids[1].price AS bid, asks[1].price AS ask, (bids[1].price + asks[1].price) / 2 AS mid FROM b)
SELECT k, {r6('bid')} AS bid, {r6('ask')} AS ask, {r6('(ask - bid) / mid * 10000')} AS spread, {r6('oi * mid')} AS oi,
  {r6(_depth('bids', 'bid', 10))} AS b10, {r6(_depth('asks', 'ask', 10))} AS a10, {r6(_depth('bids', 'bid', 25))} AS b25, {r6(_depth('asks', 'ask', 25))} AS a25,
  {r6('coalesce(list_sum([x.price * x.qty FOR x IN bids[1:2]]), 0)')} AS first2 FROM m""")
def _market(spark, sf):
    m = P.market_metrics(books(spark, sf))
    return m.select("k", "bid", "ask", F.col("spreadBps").alias("spread"), F.col("openInterestNotional").alias("oi"),
                    F.col("bidDepth10bps").alias("b10"), F.col("askDepth10bps").alias("a10"), F.col("bidDepth25bps").alias("b25"),
                    F.col("askDepth25bps").alias("a25"), P.first_levels_notional(F.col("bids"), 2).alias("first2"))


@check("stale_fallback", """WITH live AS (SELECT o_custkey AS symbol, max(epoch_ms(o_orderdate)) AS snapshot_t, max(o_totalprice) AS last FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
prev AS (SELECT o_custkey AS symbol, max(epoch_ms(o_orderdate)) AS snapshot_t, max(o_totalprice) AS last FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
ok AS (SELECT * FROM prev WHERE (996624000000 - snapshot_t) / 1000 BETWEEN 0 AND 50000000)
SELECT coalesce(l.symbol, p.symbol) AS symbol, l.symbol IS NULL AS stale, CASE WHEN l.symbol IS NULL THEN p.snapshot_t ELSE l.snapshot_t END AS snapshot_t,
  CASE WHEN l.symbol IS NULL THEN p.last ELSE l.last END AS last FROM live l FULL JOIN ok p ON l.symbol = p.symbol""")
def _stale(spark, sf):
    o = table(spark, sf, "orders")

    def snap(df):
        return df.groupBy(F.col("o_custkey").alias("symbol")).agg(
            F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("snapshot_t"), F.max("o_totalprice").alias("last"))

    return P.stale_fallback(snap(o.where("o_orderstatus = 'O'")), snap(o.where("o_orderstatus <> 'O'")), 996_624_000_000, 50_000_000)
