"""Signals to trades, trades to metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.operators import layout as L

BASE_COST, STRESS_COST, LOW_COST = 0.0014, 0.0015, 0.0006
# Fewest trades for an evidence pass, by timeframe.
MIN_TRADES = {"1m": 50, "5m": 30, "15m": 25, "1h": 20, "4h": 10, "1d": 3}
WHO = ("symbol", "timeframe", "strategy_id")


def min_trades(timeframe: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIN_TRADES.items() for x in kv])
    return F.coalesce(table[timeframe], F.lit(20))


def last_bars(bars: DataFrame) -> DataFrame:
    """Last time and close of each series: one row per series."""
    by = [c for c in ("symbol", "timeframe", "part") if c in bars.columns]
    return bars.groupBy(*by).agg(F.max("t").alias("last_t"), F.max_by("c", "t").alias("last_c"))


def trades(signals: DataFrame, last: DataFrame, trade_start: Column | int | None = None) -> DataFrame:
    """Next-open trades of reversal flips and target positions alike.

    A signal acts at the open of the next bar.  Signals whose entry bar lies
    before ``trade_start`` are dropped before repeats are removed, so they do
    not move the position; the last position closes at the last close.
    """
    by = [c for c in ("symbol", "timeframe", "part") if c in signals.columns] + ["strategy_id"]
    chunk = L.BLOCK if L.BLOCK in signals.columns else None
    acting = signals.where(F.col("next_t").isNotNull())
    if trade_start is not None:
        acting = acting.where(F.col("next_t") >= trade_start)
    marked = L.neighbour(acting, by, "t", {"_prev": "sig"}, chunk)
    changes = marked.where(F.col("sig") != F.coalesce(F.col("_prev"), F.lit(0))).drop("_prev")
    ended = L.neighbour(changes, by, "t", {"_xt": "next_t", "_xo": "next_o"}, chunk, ahead=True)
    held = ended.where("sig <> 0").join(last, [c for c in by if c != "strategy_id"])
    price = F.coalesce("_xo", "last_c")
    gross = F.when(F.col("sig") == 1, price / F.col("next_o") - 1).otherwise(F.col("next_o") / price - 1)
    keys = [*by, chunk] if chunk else by
    return held.select(*keys, F.col("sig").alias("side"), F.col("next_t").alias("entry_t"),
                       F.coalesce("_xt", "last_t").alias("exit_t"), gross.alias("gross"))


def trade_metrics(trades: DataFrame, by: list[str], cost: Column, start: Column, end: Column,
                  clamp_low: bool = False) -> DataFrame:
    """n, wr, net, pf, dd, exp, sh, posseg and the three time thirds per group.

    Equity and drawdown run in two levels: inside calendar months of entries,
    then over the month summaries.  A group of any size is therefore spread
    over its months, and the result is the same as one run over all trades.
    ``clamp_low`` puts entries before ``start`` into the first third.
    """
    r = F.col("gross") - cost
    width = (end - start) / 3
    third = F.least(F.lit(2), F.floor((F.col("entry_t") - start) / width))
    if clamp_low:
        third = F.when(width > 0, F.greatest(F.lit(0), third)).otherwise(0)
    month = F.date_trunc("month", F.timestamp_millis("entry_t"))
    rows = trades.select(*by, "entry_t", r.alias("r"), third.alias("third"), month.alias("_m"))
    inner = Window.partitionBy(*by, "_m").orderBy("entry_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("e", F.product(F.greatest(F.lit(1e-9), 1 + F.col("r"))).over(inner))
    rows = rows.withColumn("top", F.max("e").over(inner))
    one = F.lit(1.0)
    months = rows.groupBy(*by, "_m").agg(
        F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("wins"),
        F.sum("r").alias("s"), F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("gw"),
        F.sum(F.when(F.col("r") < 0, F.col("r"))).alias("gl"),
        F.max_by("e", "entry_t").alias("p"), F.max("e").alias("hi"), F.min("e").alias("lo"),
        F.max(1 - F.col("e") / F.col("top")).alias("dd"),
        *[F.coalesce(F.product(F.when(F.col("third") == j, 1 + F.col("r"))), one).alias(f"g{j}") for j in range(3)],
        F.avg("r").alias("m"), F.var_pop("r").alias("vp"),
    )
    before = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("eq0", F.coalesce(F.product("p").over(before), one))
    months = months.withColumn("pk0", F.greatest(one, F.coalesce(F.max(F.col("eq0") * F.col("hi")).over(before), one)))
    months = months.withColumn("dd", F.greatest(F.col("dd"), 1 - F.col("eq0") * F.col("lo") / F.col("pk0")))
    mean = F.sum("s") / F.sum("n")
    # Sum of squares about the mean, from the months' own moments.
    whole = months.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), mean.alias("exp"),
        F.sum(F.col("vp") * F.col("n")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("parts"),
        F.product("p").alias("eq"), F.max("dd").alias("dd"),
        F.coalesce(F.sum("gw"), F.lit(0.0)).alias("gw"), F.coalesce(F.sum("gl"), F.lit(0.0)).alias("gl"),
        *[(F.product(f"g{j}") - 1).alias(f"seg{j}") for j in range(3)],
    )
    between = F.aggregate("parts", F.lit(0.0),
                          lambda a, x: a + x["n"] * (x["m"] - F.col("exp")) * (x["m"] - F.col("exp")))
    sd = F.when(F.col("n") > 1, F.sqrt((F.col("within") + between) / (F.col("n") - 1)))
    pf = F.when(F.col("gl") < 0, F.col("gw") / -F.col("gl")).when(F.col("gw") > 0, 999.0).otherwise(0.0)
    seg = [F.col(f"seg{j}") for j in range(3)]
    return whole.select(
        *by, F.col("n"), (F.col("wins") / F.col("n")).alias("wr"), (F.col("eq") - 1).alias("net"), pf.alias("pf"),
        F.greatest(F.lit(0.0), F.col("dd")).alias("dd"), F.col("exp"),
        F.when(sd > 0, F.col("exp") / sd * F.sqrt(F.col("n"))).otherwise(0.0).alias("sh"),
        sum((F.when(x > 0, 1).otherwise(0) for x in seg), F.lit(0)).alias("posseg"), F.array(*seg).alias("seg"))


def evidence_pass(n: Column, least: Column, net: Column, exp: Column, pf: Column, posseg: Column,
                  stress_net: Column | None) -> Column:
    ok = (n >= least) & (net > 0) & (exp > 0) & (pf > 1.05) & (posseg >= 2)
    return ok if stress_net is None else ok & (stress_net > 0)


def evaluate(trades: DataFrame, start: Column, end: Column, by: list[str] = list(WHO),
             costs: tuple[float, float, float] = (BASE_COST, STRESS_COST, LOW_COST),
             least: Column | None = None, require_stress: bool = True, clamp_low: bool = False) -> DataFrame:
    """Result rows: base metrics, stress and low-cost net, long-only and short-only parts.

    Each trade is copied once per view it belongs to (three costs, one side),
    so every view comes from one aggregation.
    """
    base, stress, low = costs
    views = F.array(
        F.struct(F.lit("base").alias("view"), F.lit(base).alias("cost")),
        F.struct(F.lit("stress").alias("view"), F.lit(stress).alias("cost")),
        F.struct(F.lit("low").alias("view"), F.lit(low).alias("cost")),
        F.struct(F.when(F.col("side") == 1, "long").otherwise("short").alias("view"), F.lit(base).alias("cost")),
    )
    spread = trades.withColumn("_v", F.explode(views)).select("*", "_v.view", "_v.cost")
    m = trade_metrics(spread, [*by, "view"], F.col("cost"), start, end, clamp_low)

    def of(view: str, col: str, fallback) -> Column:
        return F.coalesce(F.max(F.when(F.col("view") == view, F.col(col))), F.lit(fallback))

    names = ("n", "wr", "net", "pf", "dd", "exp")
    kinds = (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    wide = m.groupBy(*by).agg(
        *[of("base", c, k).alias(c) for c, k in zip((*names, "sh", "posseg"), (*kinds, 0.0, 0))],
        F.max(F.when(F.col("view") == "base", F.col("seg"))).alias("seg"),
        of("stress", "net", 0.0).alias("net15"), of("low", "net", 0.0).alias("net6"),
        *[of(side, c, k).alias(f"{side}_{c}") for side in ("long", "short") for c, k in zip(names, kinds)],
    )
    need = least if least is not None else (min_trades(F.col("timeframe")) if "timeframe" in by else F.lit(20))
    stress_net = F.col("net15") if require_stress else None
    return wide.withColumn("min_trades", need.cast("int")).withColumn(
        "pass", evidence_pass(F.col("n"), F.col("min_trades"), F.col("net"), F.col("exp"), F.col("pf"),
                              F.col("posseg"), stress_net))


# --- currency trades, fills -----------------------------------------------------


def _factor(gw: Column, gl: Column) -> Column:
    return F.when(gl < 0, gw / -gl).when(gw > 0, 999.0).otherwise(0.0)


def _currency(trades: DataFrame, by: list[str], start: Column, end: Column) -> DataFrame:
    """Counts and sums of ``profit``; thirds of [start, end) by exit time."""
    p, x = F.col("profit"), F.col("exit_t")
    width = (end - start) / 3
    third = F.greatest(F.lit(0), F.least(F.lit(2), F.floor((x - start) / width)))
    inside = (x >= start) & (x < end)
    out = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(p > 0).alias("wins"), F.sum(p).alias("net_profit"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(p < 0, p).otherwise(0.0)).alias("gross_loss"),
        *[F.sum(F.when(inside & (third == j), p).otherwise(0.0)).alias(f"seg{j}") for j in range(3)])
    return out.withColumns({
        "pf": _factor(F.col("gross_profit"), F.col("gross_loss")),
        "posseg": sum((F.when(F.col(f"seg{j}") > 0, 1).otherwise(0) for j in range(3)), F.lit(0))})


def currency_metrics(trades: DataFrame, by: list[str], capital: float, start: int, end: int, least: int) -> DataFrame:
    """Metrics of trades that carry a currency ``profit``."""
    out = _currency(trades, by, F.lit(start), F.lit(end))
    ok = (F.col("n") >= least) & (F.col("net_profit") > 0) & (F.col("pf") > 1.05) & (F.col("posseg") >= 2)
    return out.withColumns({"wr": F.col("wins") / F.col("n"), "net_pct": F.col("net_profit") / capital * 100, "pass": ok})


def monthly_roll_forward(trades: DataFrame, windows: DataFrame, by: list[str], capital: float, least: int) -> DataFrame:
    """Return of each exit month on the equity realised before it; empty months count as zero.

    ``windows`` are calendar months for all groups, or hold some of ``by``: then each has its own.
    """
    own = [c for c in by if c in windows.columns]
    month = F.date_format(F.timestamp_millis("exit_t"), "yyyy-MM")
    placed = trades.withColumn("month", month).join(windows, [*own, "month"]).where(
        (F.col("exit_t") >= F.col("start")) & (F.col("exit_t") < F.col("end")))
    sums = _currency(placed, [*by, "month", "start", "end"], F.col("start"), F.col("end")).drop("start", "end")
    # Groups times calendar months: the month table is bounded by the range.
    groups = trades.select(*by).distinct()
    grid = groups.join(windows.select(*own, "month"), own) if own else groups.crossJoin(F.broadcast(windows.select("month")))
    full = grid.join(sums, [*by, "month"], "left").na.fill(0)
    before = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.lit(capital) + F.coalesce(F.sum("net_profit").over(before), F.lit(0.0))
    out = full.withColumn("start_equity", opened)
    ok = (F.col("n") >= least) & (F.col("net_profit") > 0) & (F.col("pf") > 1.05) & (F.col("posseg") >= 2)
    return out.select(*by, "month", "n", "net_profit", "start_equity",
                      F.when(F.col("start_equity") > 0, F.col("net_profit") / F.col("start_equity") * 100).alias("ret_pct"),
                      "pf", "posseg", ok.alias("pass"))


class AverageCost:
    """Average-cost position of one symbol over signed fills."""

    def __init__(self):
        self.pos = self.avg = 0.0

    def step(self, qty: float, price: float):
        gain = 0.0
        held, added, total = abs(self.pos), abs(qty), self.pos + qty
        if held < 1e-12 or (self.pos > 0) == (qty > 0):
            self.avg = (self.avg * held + price * added) / (held + added) if abs(total) > 1e-12 else 0.0
        else:
            edge = price - self.avg if self.pos > 0 else self.avg - price
            gain = edge * min(held, added)
            if abs(total) < 1e-12:
                total = self.avg = 0.0
            elif (total > 0) != (self.pos > 0):
                self.avg = price
        self.pos = total
        return gain, self.pos, self.avg

    # A position is a sum; once it is known at a block's start, each fill maps the average cost affinely.
    levels = 2
    parts = (("pos",), ("avg",))

    def summary(self, level: int, qty, price):
        if level == 0:
            return float(np.cumsum(qty)[-1])
        after = np.cumsum(np.concatenate([[self.pos], qty]))
        before, total, added = after[:-1], after[1:], np.abs(qty)
        held, flat = np.abs(before), np.abs(total) < 1e-12
        adds = (held < 1e-12) | ((before > 0) == (qty > 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            keep = np.where(flat, 0.0, np.where(adds, held / (held + added), np.where((total > 0) != (before > 0), 0.0, 1.0)))
            put = np.where(flat, 0.0, np.where(adds, price * added / (held + added), np.where((total > 0) != (before > 0), price, 0.0)))
        later = np.concatenate([np.cumprod(keep[::-1])[::-1][1:], [1.0]])  # what later fills keep of a fill's part
        return float(keep[0] * later[0]), float(np.sum(put * later))

    def advance(self, level: int, summary) -> None:
        if level == 0:
            self.pos += summary
        else:
            self.avg = summary[0] * self.avg + summary[1]


def position_ledger(fills: DataFrame, block_rows: int | None = None, longest: int | None = None, tie: str | None = None) -> DataFrame:
    """Realised profit, position and average cost after each fill, per symbol.

    Fills of one time follow the column ``tie``; without it times must be distinct. A symbol with more fills than one task should hold is cut into blocks; their
    positions and average costs are folded, so the passes do not grow with the blocks.
    """
    rows = fills.withColumn("timeframe", F.lit("fills")) if "timeframe" not in fills.columns else fills
    if block_rows is None and (L.longest_series(rows) if longest is None else longest) > L.DEFAULT_BLOCK_ROWS:
        block_rows = L.DEFAULT_BLOCK_ROWS
    if tie:  # the step order is the fill's number
        rows = L.with_index(rows, tie=tie).withColumns({"_time": F.col("t"), "t": F.col(L.INDEX)})
    laid = L.into_blocks(rows, block_rows) if block_rows else L.spread(rows)
    out = L.scan_series(laid, [L.Scan(AverageCost, ("qty", "price"), ("realised", "position", "avg_cost"))])
    if tie:
        out = out.withColumn("t", F.col("_time")).drop("_time", L.INDEX)
    return out.drop("timeframe", *([L.BLOCK, L.INDEX] if block_rows else []))


def net_position(fills: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Signed fills plus manual adjustments per symbol."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    a = fills.groupBy("symbol").agg(F.sum(signed).alias("from_fills"))
    b = adjustments.groupBy("symbol").agg(F.sum("quantity_delta").alias("from_adjustments"))
    return a.join(b, "symbol", "full").na.fill(0.0).withColumn(
        "net", F.col("from_fills") + F.col("from_adjustments"))


def implementation_shortfall(fills: DataFrame, intents: DataFrame) -> DataFrame:
    """Signed slippage in basis points; a repeated fill id counts once."""
    cols = [c for c in fills.columns if c not in ("fill_id", "event_time")]
    once = fills.groupBy("fill_id").agg(F.min(F.struct("event_time", *cols)).alias("f")).select("fill_id", "f.*")
    side = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    joined = once.join(intents.select("intent_id", "expected_price"), "intent_id", "left")
    bps = F.when(F.col("expected_price") > 0, side * (F.col("fill_price") - F.col("expected_price")) / F.col("expected_price") * 1e4)
    return joined.withColumn("shortfall_bps", bps)
