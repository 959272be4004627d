"""Ranking boards over result rows.

A result row is one strategy on one symbol and timeframe with ``family, n, net,
pf, dd, exp, posseg, net15, min_trades, pass, coverage``.  Ties end on the
symbol and strategy so that every ranking is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tradability thresholds.
POLICY = {
    "hard": {"spread": 25.0, "volume": 500_000.0, "depth": 250.0, "oi": 500_000.0},
    "strong": {"spread": 3.0, "volume": 20_000_000.0, "depth": 10_000.0, "oi": 10_000_000.0},
    "tradeable": {"spread": 8.0, "volume": 3_000_000.0, "depth": 1_000.0, "oi": 2_000_000.0},
}
STATUS_RANK = {"STRONG": 3, "TRADEABLE": 2, "REVIEW": 1, "BLOCK": 0}


def rankable() -> Column:
    return ((F.col("n") >= F.least(F.lit(5), F.col("min_trades"))) & (F.col("net") > 0) & (F.col("exp") > 0)
            & (F.col("pf") > 1) & (F.col("net15") > 0))


def review_flags() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("n") < F.col("min_trades"), "LOW_SAMPLE"), F.when(~F.col("pass"), "NOT_EVIDENCE_PASS"),
        F.when(F.col("dd") > 0.45, "HIGH_DD"), F.when(F.col("net") > 5, "EXTREME_COMPOUNDING"),
        F.when(F.col("pf") > 8, "EXTREME_PF"), F.when(F.col("posseg") < 2, "UNSTABLE_SEGMENTS"),
        F.when(F.coalesce("coverage", F.lit(1.0)) < 0.95, "PARTIAL_COVERAGE")))


def prepared(results: DataFrame) -> DataFrame:
    if "coverage" not in results.columns:
        results = results.withColumn("coverage", F.lit(1.0))
    return results.withColumns({"rankable": rankable(), "flags": review_flags(), "underlying": underlying_of(F.col("symbol"))})


def underlying_of(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "(USDT|USDC)$", "")


def _by_net(*tail: str) -> list[Column]:
    return [F.desc("net"), *[F.col(c) for c in tail]]


def top_per_group(board: DataFrame, k: int = 5) -> DataFrame:
    """Best ``k`` rankable rows of each strategy and timeframe."""
    w = Window.partitionBy("strategy_id", "timeframe").orderBy(*_by_net("symbol"))
    return board.where("rankable").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_per_underlying(board: DataFrame, k: int = 5) -> DataFrame:
    """As above, counting each underlying once."""
    best = Window.partitionBy("strategy_id", "timeframe", "underlying").orderBy(*_by_net("symbol"))
    once = board.where("rankable").withColumn("_b", F.row_number().over(best)).where("_b = 1").drop("_b")
    return top_per_group(once, k)


def coin_cards(board: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(*_by_net("strategy_id", "timeframe"))
    return board.where("rankable").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def global_top(board: DataFrame, k: int = 100, only: str = "rankable") -> DataFrame:
    return board.where(only).orderBy(*_by_net("symbol", "strategy_id", "timeframe")).limit(k)


def consensus(board: DataFrame) -> DataFrame:
    """Symbols on which at least two families agree."""
    return (board.where("rankable").groupBy("symbol").agg(
        F.countDistinct("family").alias("families"), F.count("*").alias("combinations"),
        F.count_if("pass").alias("evidence"), F.max("net").alias("best_net"),
        F.sort_array(F.collect_set("strategy_id")).alias("strategies")).where("families >= 2"))


def strategy_summary(results: DataFrame, by: list[str] = ["strategy_id"], upper_middle: bool = False) -> DataFrame:  # noqa: B006
    """Pass and positive rates and medians; ``upper_middle`` takes element n/2 of the sorted values."""
    def mid(c: str) -> Column:
        # From the top, the discrete median of an even count is the upper one.
        return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)") if upper_middle else F.percentile(c, 0.5)

    n, ok, pos = F.count("*"), F.count_if("pass"), F.count_if(F.col("net") > 0)
    return results.groupBy(*by).agg(
        n.alias("tested"), ok.alias("passes"), (ok / n).alias("pass_rate"), pos.alias("positive"),
        (pos / n).alias("positive_rate"), mid("net").alias("median_net"), mid("pf").alias("median_pf"),
        mid("dd").alias("median_dd"), mid("n").alias("median_trades"))


def multi_strategy_symbols(results: DataFrame) -> DataFrame:
    return results.where("pass").groupBy("symbol").agg(
        F.count("*").alias("passing"), F.sort_array(F.collect_list("strategy_id")).alias("strategies"),
        F.max("net").alias("best_net"))


def clean() -> Column:
    return F.col("pass") & (F.col("dd") <= 0.40) & (F.col("pf") >= 1.20) & (F.col("net") > 0.10)


def _matrix(rows: DataFrame, key: str) -> DataFrame:
    ev = F.col("pass")
    card = F.struct((-F.col("net")).alias("order"), "symbol", "strategy_id", "timeframe", "net", "pf", "dd", "n")
    # A key has at most one row per strategy and timeframe (and contract).
    best = lambda on, k: F.transform(
        F.slice(F.sort_array(F.collect_list(F.when(on, card))), 1, k),
        lambda x: F.concat_ws(":", x["symbol"], x["strategy_id"], x["timeframe"]))
    return rows.groupBy(key).agg(
        F.sort_array(F.collect_set("symbol")).alias("contracts"), F.count_if(ev).alias("evidence"),
        F.countDistinct(F.when(ev, F.col("timeframe"))).alias("timeframes"),
        F.countDistinct(F.when(ev, F.col("strategy_id"))).alias("strategies"),
        F.countDistinct(F.when(ev, F.col("family"))).alias("families"), F.count_if(clean()).alias("clean"),
        F.max("net").alias("best_net"), F.max(F.when(ev, F.col("net"))).alias("best_evidence_net"),
        F.percentile(F.when(ev, F.col("net")), 0.5).alias("median_net"),
        F.percentile(F.when(ev, F.col("dd")), 0.5).alias("median_dd"), F.max(F.when(ev, F.col("dd"))).alias("max_dd"),
        best(clean(), 5).alias("best_clean"), best(F.lit(True), 8).alias("all_top"))


def contract_matrix(board: DataFrame) -> DataFrame:
    return _matrix(board.where("rankable"), "symbol")


def underlying_matrix(board: DataFrame) -> DataFrame:
    """Per underlying, the best contract of each strategy and timeframe.

    Evidence takes the best passing row, the rest the best row of any kind.
    """
    keys = ["underlying", "strategy_id", "timeframe"]
    cols = [c for c in board.columns if c not in keys]
    top = F.max_by(F.struct(*cols), F.struct("net", "symbol"))
    rows = board.where("rankable")
    ranked = rows.groupBy(*keys).agg(top.alias("r")).select(*keys, "r.*")
    proof = rows.where("pass").groupBy(*keys).agg(top.alias("r")).select(*keys, "r.*")
    names = rows.groupBy("underlying").agg(F.sort_array(F.collect_set("symbol")).alias("contracts"))
    whole = _matrix(ranked, "underlying").select("underlying", "best_net", "all_top")
    part = _matrix(proof, "underlying").drop("contracts", "best_net", "all_top")
    counts = ["evidence", "timeframes", "strategies", "families", "clean"]
    return names.join(whole, "underlying").join(part, "underlying", "left").na.fill(0, counts)


def management_watchlist(matrix: DataFrame, k: int = 50) -> DataFrame:
    return (matrix.where("timeframes >= 2 AND families >= 2 AND clean >= 2")
            .orderBy(F.desc("timeframes"), F.desc("families"), F.desc("clean"), F.desc("best_evidence_net"), "underlying").limit(k))


def deployment_candidates(matrix: DataFrame, k: int = 50) -> DataFrame:
    return (matrix.where("timeframes >= 3 AND families >= 2 AND clean >= 4 AND median_dd <= 0.35")
            .orderBy(F.desc("clean"), F.desc("timeframes"), F.desc("families"), F.desc("best_evidence_net"), "underlying").limit(k))


def high_profit_review(board: DataFrame, k: int = 100) -> DataFrame:
    return global_top(board.where(F.size("flags") > 0), k)


def timeframe_summary(board: DataFrame) -> DataFrame:
    return board.groupBy("timeframe").agg(
        F.countDistinct("symbol").alias("symbols"), F.count("*").alias("combinations"),
        F.count_if("pass").alias("evidence"), F.count_if("rankable").alias("rankable"))


# --- tradability -----------------------------------------------------------------


def min_depth() -> Column:
    return F.least(F.coalesce("bidDepth10bps", F.lit(0.0)), F.coalesce("askDepth10bps", F.lit(0.0)))


def with_tradability(snapshot: DataFrame, depth_advisory: bool = False, policy: dict = POLICY) -> DataFrame:
    """Status and hard reasons of each contract; thin depth alone may be advisory."""
    q, oi = F.coalesce("quoteVolume24h", F.lit(0.0)), F.coalesce("openInterestNotional", F.lit(0.0))
    s = F.coalesce("spreadBps", F.lit(float("inf")))
    d, hard = min_depth(), policy["hard"]
    reasons = F.array_compact(F.array(
        F.when(s > hard["spread"], "SPREAD_HARD"), F.when(q < hard["volume"], "QUOTE_VOLUME_HARD"),
        F.when(d < hard["depth"], "MIN_DEPTH_10BPS"), F.when(oi < hard["oi"], "OPEN_INTEREST_HARD")))
    blocking = F.array_remove(reasons, "MIN_DEPTH_10BPS") if depth_advisory else reasons

    def meets(level: str) -> Column:
        p = policy[level]
        return (q >= p["volume"]) & (s <= p["spread"]) & (d >= p["depth"]) & (oi >= p["oi"])

    status = (F.when(F.size(blocking) > 0, "BLOCK").when(meets("strong"), "STRONG")
              .when(meets("tradeable"), "TRADEABLE").otherwise("REVIEW"))
    return snapshot.withColumns({"status": status, "reasons": reasons})


def status_rank(status: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[status], F.lit(-1))


def execution_watchlist(candidates: DataFrame, snapshot: DataFrame, depth_advisory: bool = False) -> DataFrame:
    """Best contract of each candidate underlying and its alternatives.

    ``candidates`` has ``underlying`` and an array ``contracts``.
    """
    rated = with_tradability(snapshot, depth_advisory).select(
        F.col("symbol").alias("contract"), "status", "reasons", min_depth().alias("depth"),
        F.coalesce("quoteVolume24h", F.lit(0.0)).alias("volume"),
        F.coalesce("spreadBps", F.lit(float("inf"))).alias("spread"), F.lit(True).alias("seen"))
    spread = candidates.select("underlying", F.element_at("contracts", 1).alias("first"),
                               F.explode_outer("contracts").alias("contract"))
    joined = spread.join(rated, "contract", "left")
    order = F.struct((-status_rank(F.col("status"))).alias("r"), (-F.col("depth")).alias("d"), (-F.col("volume")).alias("v"),
                     F.col("spread").alias("s"), "contract")
    # A contract list is a handful of quote currencies per underlying.
    grouped = joined.groupBy("underlying", "first").agg(
        F.sort_array(F.collect_list(F.when(F.col("seen"), F.struct(order.alias("k"), "contract", "status", "reasons")))).alias("all"))
    top = F.get("all", F.lit(0))
    return grouped.select(
        "underlying", F.coalesce(top["contract"], F.col("first")).alias("contract"),
        F.coalesce(top["status"], F.lit("NO_MARKET_SNAPSHOT")).alias("status"),
        F.coalesce(top["reasons"], F.array().cast("array<string>")).alias("reasons"),
        F.transform(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), lambda x: F.concat_ws(":", x["contract"], x["status"])).alias("alternatives"))


# --- book levels --------------------------------------------------------------------


def depth_notional(levels: Column, mid: Column, side: str, max_bps: float) -> Column:
    """Sum of price times quantity within ``max_bps`` of the mid."""
    def away(x: Column) -> Column:
        d = mid - x["price"] if side == "bid" else x["price"] - mid
        return d / mid * 10_000.0

    near = F.filter(levels, lambda x: away(x) <= max_bps)
    return F.aggregate(near, F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])


def first_levels_notional(levels: Column, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["price"] * x["qty"])


def market_metrics(books: DataFrame) -> DataFrame:
    """Spread, mid and depths from ``bids`` and ``asks`` (best level first)."""
    bid, ask = F.element_at("bids", 1)["price"], F.element_at("asks", 1)["price"]
    mid = (bid + ask) / 2
    rows = books.withColumns({"bid": bid, "ask": ask, "mid": mid})
    m = F.col("mid")
    return rows.withColumns({
        "spreadBps": (F.col("ask") - F.col("bid")) / m * 10_000.0,
        "openInterestNotional": F.col("openInterestBase") * m,
        **{f"{side}Depth{k}bps": depth_notional(F.col(f"{side}s"), m, side, k) for side in ("bid", "ask") for k in (10, 25)}})


def stale_fallback(live: DataFrame, previous: DataFrame, as_of: int, max_age_s: float = 180) -> DataFrame:
    """Live rows, and recent previous rows of the symbols that are missing."""
    cols = [c for c in live.columns if c not in ("symbol", "snapshot_t")]
    age = (F.lit(as_of) - F.col("snapshot_t")) / 1000
    old = previous.where((age >= 0) & (age <= max_age_s)).select("symbol", F.struct("snapshot_t", *cols).alias("old"))
    new = live.select("symbol", F.struct("snapshot_t", *cols).alias("new"))
    both = new.join(old, "symbol", "full")
    return both.select("symbol", F.col("new").isNull().alias("stale"), F.coalesce("new", "old").alias("r")).select(
        "symbol", "stale", "r.*")
