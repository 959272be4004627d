import brute
import pytest
from conftest import make_rows
from pyspark.sql import functions as F

from barlight.operators import bars as B
from barlight.operators import features as X
from barlight.operators import gates as G
from barlight.operators import trades as T
from barlight.plans import monitor as M
from barlight.strategies.registry import signals
from barlight.strategies.sweeps import range_reclaim

BAR = "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double"
SIG = "symbol string, timeframe string, strategy_id string, mode string, t bigint, sig int, next_t bigint, next_o double"


def test_prefixes_agree_with_the_full_run(bars):
    cuts = [r[0] for r in bars.where("symbol = 'AAAUSDT'").select("t").orderBy("t").collect()][150::130]
    ids = ["pmax", "alphatrend", "sr25_kernel_supply_demand", "sr25_trendline_breakout", "swp_fvg_after", "sr25_week_month_sweep",
           "vis_adx_di", "vis_nadaraya_watson", "harmonic_prz"]
    assert G.causality_audit(bars, cuts, ids, 10).isEmpty()


def test_too_early_signals_do_not_move_the_position(spark):
    sig = spark.createDataFrame([("A", "1h", "s", "REVERSAL", t, s, t + 1, 10.0 + t) for t, s in ((1, 1), (5, 1), (7, -1), (9, -1))], SIG)
    last = spark.createDataFrame([("A", "1h", 20, 30.0)], "symbol string, timeframe string, last_t bigint, last_c double")
    got = {(r.side, r.entry_t, r.exit_t): r.gross for r in T.trades(sig, last, 4).collect()}
    assert set(got) == {(1, 6, 8), (-1, 8, 20)}
    assert got[(1, 6, 8)] == pytest.approx(17 / 15 - 1) and got[(-1, 8, 20)] == pytest.approx(17 / 30 - 1)


def test_drawdown_over_month_pieces_equals_one_pass(spark):
    day = 86_400_000
    returns = [0.05, -0.2, 0.1, -0.02, 0.3, -0.4, 0.05, 0.06, -0.1, 0.2, -0.05, 0.01]
    rows = [("A", "1h", "s", 1, i * 17 * day, i * 17 * day + 1, r + 0.001) for i, r in enumerate(returns)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, strategy_id string, side int, entry_t bigint, exit_t bigint, gross double")
    m = T.trade_metrics(df, ["strategy_id"], F.lit(0.001), F.lit(0), F.lit(210 * day)).first()
    net, dd = brute.drawdown(returns)
    assert (m.n, m.net, m.dd) == (12, pytest.approx(net), pytest.approx(dd))
    mean = sum(returns) / 12
    sd = (sum((x - mean) ** 2 for x in returns) / 11) ** 0.5
    assert m.exp == pytest.approx(mean) and m.sh == pytest.approx(mean / sd * 12 ** 0.5)
    assert sum(1 for g in m.seg if g > 0) == m.posseg


def test_results_without_losses_have_factor_999(spark):
    df = spark.createDataFrame([("A", "1h", "s", 1, 1, 2, 0.5)], "symbol string, timeframe string, strategy_id string, side int, entry_t bigint, exit_t bigint, gross double")
    r = T.evaluate(df, F.lit(0), F.lit(10)).first()
    assert (r.pf, r.sh, r.short_n, r.long_n, bool(r["pass"])) == (999.0, 0.0, 0, 1, False)


def test_short_histories_have_no_windows(spark, bars):
    assert B.walk_forward_labels(bars.where("symbol = 'AAAUSDT'").orderBy("t").limit(29)).isEmpty()


def test_feature_lookbacks_are_checked(bars):
    with pytest.raises(ValueError):
        X.features(bars, {"level": 1})


def test_features_read_earlier_bars_only(bars):
    cut = bars.where("symbol = 'AAAUSDT'").agg(F.percentile("t", 0.5)).first()[0]
    one = X.features(bars.where("symbol = 'AAAUSDT'"), longest=10)
    changed = bars.where("symbol = 'AAAUSDT'").withColumn("c", F.when(F.col("t") > cut, F.col("l")).otherwise(F.col("c")))
    two = X.features(changed, longest=10)
    cols = ["t", *X.FEATURES]
    assert one.where(F.col("t") <= cut).select(cols).exceptAll(two.where(F.col("t") <= cut).select(cols)).isEmpty()
    assert not one.select(cols).exceptAll(two.select(cols)).isEmpty()
    # Cut into blocks, the features are the same.
    blocks = X.features(bars.where("symbol = 'AAAUSDT'"), longest=10**9, block_rows=150)
    assert one.select(cols).exceptAll(blocks.select(cols)).isEmpty()


def test_paths_over_blocks(bars):
    one = X.with_paths(X.features(bars, longest=10), [3, 12])
    two = X.with_paths(X.features(bars, longest=10**9, block_rows=150), [3, 12], 150)
    cols = ["symbol", "t", "x3", "hi3", "lo12", "x12"]
    assert one.select(cols).exceptAll(two.select(cols)).isEmpty()


def test_range_48_variant_equals_the_catalogue(spark, bars):
    v = G.build_variants(spark, {"lookback": [48], "thresholdAtr": [0.05], "bodyConfirm": [False], "wickRatio": [0.0]})
    assert v.count() == 1 and v.first().baseline and v.first().variantId == "range_reclaim__p48__t0p05__b0__w0__r0__dboth"
    cols = ["symbol", "t", "sig"]
    a, b = range_reclaim(bars, v, [48], longest=10).select(cols), signals(bars, ["swp_range48_reclaim"], 10).select(cols)
    assert b.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_default_variant_grid(spark):
    v = G.build_variants(spark)
    assert v.count() == 80 and v.where("baseline").count() == 1 and v.select("fingerprint").distinct().count() == 80


def test_quality_of_bad_rows(spark):
    rows = [("A", "1m", t, 1.0, 2.0, l, 1.5, v) for t, l, v in ((0, 1.0, 1.0), (60, 1.0, 1.0), (60, 3.0, 1.0), (120, 1.0, -1.0), (300, 1.0, 1.0))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BAR + ", seq int")
    q = B.quality_report(df).first()
    assert (q.candles, q.interval, q.duplicates, q.non_increasing, q.invalid_ohlc, q.negative_volume, q.gaps, q.largest_gap, q["pass"]) == (5, 60, 1, 1, 1, 1, 1, 3.0, False)
    with pytest.raises(ValueError):
        B.quality_report(df, tolerance=1.0)


def test_base_timeframe():
    assert B.base_timeframe(["1m", "5m", "1h"], 14_400_000) == "1h"
    with pytest.raises(ValueError):
        B.base_timeframe(["4h"], 3_600_000)


def test_study_events_over_blocks(bars):
    costs = {"base": (0.0004, 0.0001)}
    one = X.outcomes(G.study_events(X.features(bars, longest=10), [3, 12]), [3, 12], costs)
    two = X.outcomes(G.study_events(X.features(bars, longest=10**9, block_rows=150), [3, 12]), [3, 12], costs)
    cols = ["symbol", "t", "kind", "horizon", "gross", "mae", "mfe"]
    assert one.count() > 0 and one.select(cols).exceptAll(two.select(cols)).isEmpty() and two.select(cols).exceptAll(one.select(cols)).isEmpty()


def test_tuning_over_blocks(bars):
    one, two = G.tune_thresholds(X.features(bars, longest=10)), G.tune_thresholds(X.features(bars, longest=10**9, block_rows=150))
    assert one.count() > 0 and one.exceptAll(two.select(one.columns)).isEmpty()


def test_parts_over_blocks(bars):
    cut = bars.agg(F.percentile("t", 0.6)).first()[0]
    parts = bars.withColumn("part", F.lit("a")).unionByName(bars.where(F.col("t") <= cut).withColumn("part", F.lit("b")))
    ids = ["swp_range48_reclaim", "sr25_donchian_breakout", "sr25_fvg_first_touch"]
    cols = ["symbol", "part", "t", "strategy_id", "sig"]
    one, two = signals(parts, ids, 10).select(cols), signals(parts, ids, 10**9, block_rows=150).select(cols)
    assert one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_all_alternatives(spark):
    from barlight.sources.files import markdown_table

    df = spark.range(150).toDF("n")
    assert markdown_table(df, ["n"], [F.col("n")], 150).count("\n") == 152


def test_thresholds_are_tuned_before_the_matrix(spark, bars):
    """Each series gets the thresholds of its own train window; the caller's numbers stand above them, and fixed ones stay an option."""
    from pyspark.sql import functions as F

    rows = X.features(bars, longest=10)
    tuned = G.tune_thresholds(rows, min_n=5)
    names = G.thresholds_of(tuned)
    placed = G.placed_rows(rows, [3])
    fired = X.detect_setups(placed, None, names).select("symbol", "timeframe", "t", "kind", "a", "b", "d")
    by = fired.join(tuned, ["symbol", "timeframe", "kind"])
    assert fired.count() > 10 and by.where("a < ga OR b < gb OR d < gd").isEmpty()
    above = X.detect_setups(placed, {"breakoutStrength": 1e9}, names)
    assert above.where("kind = 'breakout'").isEmpty() and above.count() == fired.where("kind <> 'breakout'").count()
    only = names.where("symbol = 'AAAUSDT'")
    other = X.detect_setups(placed, None, only).where("symbol <> 'AAAUSDT'").count()
    assert other == X.detect_setups(placed).where("symbol <> 'AAAUSDT'").count()
    matrix = {(r.symbol, r.kind): (r.status, r.passed_runs) for r in G.robustness_matrix(rows, [3, 12], min_n=5).collect()}
    stats = G.walk_forward_study(X.detect_setups(G.placed_rows(rows, [3, 12]), None, names), [3, 12], G.COSTS, rows)
    runs = G.decide_promotion(stats, [*G.SERIES, "horizon", "cost_name"], 5)
    want = {(r.symbol, r.kind): r.n for r in runs.groupBy("symbol", "kind").agg(F.count_if(F.col("status") == "PASS").alias("n")).collect()}
    assert {k: n for k, (_, n) in matrix.items()} == want and len(matrix) == 6
    assert G.robustness_matrix(rows, [3], min_n=5, tune=False).count() == 6


def test_months_of_each_series(spark):
    """A late-listed series keeps its first month, measured from its first bar; calendar windows for all stay an option."""
    day = 86_400_000
    start, end = 1_609_459_200_000, 1_609_459_200_000 + 120 * day  # 2021-01-01 on
    bar = lambda s, k: (s, "1d", start + k * day, 1.0, 2.0, 1.0, 1.5, 1.0)
    rows = [bar("A", k) for k in range(120)] + [bar("B", k) for k in range(45, 120)] + [bar("C", k) for k in (-40, 130)]
    bars = spark.createDataFrame(rows, BAR)
    own = B.series_months(bars, start, end)
    got = {(r.symbol, r.month): ((r.start - start) // day, (r.end - start) // day) for r in own.collect()}
    assert got == {("A", "2021-01"): (0, 31), ("A", "2021-02"): (31, 59), ("A", "2021-03"): (59, 90), ("A", "2021-04"): (90, 120),
                   ("B", "2021-02"): (45, 59), ("B", "2021-03"): (59, 90), ("B", "2021-04"): (90, 120)}
    known = bars.where("symbol <> 'C'")
    assert {r.coverage for r in G.month_coverage(known, own).collect()} == {1.0}
    every = {(r.symbol, r.month): r.coverage for r in G.month_coverage(known, B.month_windows(spark, start, end)).collect()}
    assert every[("B", "2021-01")] == 0.0 and every[("B", "2021-02")] == 0.5 and len(every) == 8
    sliced = {(r.symbol, r.month) for r in G.monthly_eval_sliced(known, own, ["vis_candlestick_reversal"], 1, 0.98, 200).collect()}
    assert sliced == set(got)
    trades = spark.createDataFrame([("A", start + 40 * day, 5.0), ("B", start + 50 * day, 3.0), ("B", start + 10 * day, 9.0)], "symbol string, exit_t bigint, profit double")
    rolled = T.monthly_roll_forward(trades, own.drop("timeframe"), ["symbol"], 100.0, 1)
    assert {(r.symbol, r.month): r.net_profit for r in rolled.collect()} == {k: {("A", "2021-02"): 5.0, ("B", "2021-02"): 3.0}.get(k, 0.0) for k in got}


def test_impulse_block_is_live_for_24_bars():
    """Armed by a wide, heavy bar; the newest bar sees it up to 24 bars after (and once more, as a level that then ends)."""
    state = M._BlockState()
    rows = [(2.0, 10.0, 100.0, 101.0, 99.0, 100.0, 10.0)] * 20 + [(2.0, 10.0, 100.0, 101.0, 98.0, 99.0, 10.0), (2.0, 10.0, 99.0, 106.0, 99.0, 105.0, 20.0)]
    seen = [state.step(*r) for r in rows + [(2.0, 10.0, 105.0, 106.0, 104.0, 105.0, 10.0)] * 40]
    live = [k for k, (side, _, _) in enumerate(seen) if side]
    assert live == list(range(22, 47)) and seen[22] == (1.0, 98.0, 100.0)


def live_block(closed):
    """Side and edges of the impulse block that bars up to here leave armed."""
    atr, side, ends, edges = brute.rma(brute.true_range(closed), 14), 0, -1, None
    for i in range(20, len(closed)):
        b, p, mean = closed[i], closed[i - 1], sum(x["v"] for x in closed[i - 19:i + 1]) / 20
        if side == 0:
            if b["h"] - b["l"] >= 1.5 * atr[i] and b["v"] >= 1.3 * mean:
                if b["c"] > b["o"] and p["c"] < p["o"]:
                    side, ends, edges = 1, i + 24, (p["l"], max(p["o"], p["c"]))
                elif b["c"] < b["o"] and p["c"] > p["o"]:
                    side, ends, edges = -1, i + 24, (min(p["o"], p["c"]), p["h"])
        elif i > ends or (b["l"] <= edges[1] < b["c"] if side > 0 else b["h"] >= edges[0] > b["c"]):
            side = 0
    return (side, edges) if side and len(closed) - 1 <= ends else (0, None)


def test_proximity(spark):
    """Seven rules a series; the block's levels are those of a plain pass over the closed bars."""
    rows, cuts = make_rows("A", 700), range(200, 700, 5)
    for i in range(41, 700, 41):  # a wide, heavy bar after one of the other colour
        side = 1 if i % 2 else -1
        for k, move, v in ((i - 1, -50.0, 50.0), (i, 4000.0, 500.0)):
            o = rows[k][3]
            c = o + side * move
            rows[k] = (*rows[k][:3], o, max(o, c) + 9, min(o, c) - 9, c, v)
    got = M.proximity(spark.createDataFrame([(f"A{k}", *r[1:]) for k in cuts for r in rows[k - 160:k]], BAR)).collect()
    assert len(got) == 7 * len(cuts)
    assert all(0 <= r.long_score <= 100 and 0 <= r.short_score <= 100 and r.score == max(r.long_score, r.short_score) for r in got)
    levels = {r.symbol: (r.long_level, r.short_level) for r in got if r.strategy_id == "sr25_impulse_ob_retest"}
    sides = set()
    for k in cuts:
        side, edges = live_block([dict(zip("ohlcv", r[3:])) for r in rows[k - 160:k - 1]])
        sides.add(side)
        assert levels[f"A{k}"] == ((edges[1], None) if side > 0 else (None, edges[0]) if side < 0 else (None, None))
    assert len(sides) == 3
