import copy
import math

import brute
import numpy as np
import pytest

from barlight.functions import recurrences as R
from barlight.functions.study import _Carry
from barlight.operators.trades import AverageCost
from barlight.strategies.registry import catalogue, packs, signals, wide_signals


def series(rows, symbol="AAAUSDT"):
    return [dict(zip("t o h l c v".split(), r[2:])) for r in rows if r[0] == symbol]


def run(obj, *cols):
    return [obj.step(*x) for x in zip(*cols)]


def close(a, b):
    return all((x is None or math.isnan(x)) == (y is None) and (y is None or abs(x - y) < 1e-9) for x, y in zip(a, b))


def test_means_and_rsi(rows):
    c = [x["c"] for x in series(rows)]
    assert close(run(R.Ema(9), c), brute.ema(c, 9))
    assert close(run(R.Rma(14), c), brute.rma(c, 14))
    assert close(run(R.Rsi(14), c), brute.rsi(c, 14))


def test_ema_restarts_after_a_gap():
    e = R.Ema(3)
    assert [e.step(4.0), e.step(8.0)] == [4.0, 6.0]
    assert math.isnan(e.step(math.nan)) and e.step(10.0) == 10.0


@pytest.mark.parametrize("make,width", [(lambda: R.Ema(7), 1), (lambda: R.Rma(5), 1), (lambda: R.Rma(1), 1), (lambda: R.Rsi(4), 1), (R.Macd, 1), (lambda: R.Adx(5), 3), (R.AnchoredVwap, 3), (_Carry, 1), (AverageCost, 2)])
@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_columns_at_once_and_folded_blocks(make, width, gaps):
    """``values`` gives what ``step`` gives, and ``advance`` by summaries leads to the states that stepping leads to."""
    rng = np.random.default_rng(width)
    for n in (1, 2, 5, 40, 300):
        cols = [rng.integers(-5, 6, n).astype(float) + (k > 0) * 20 for k in range(width)]
        if make is R.AnchoredVwap:
            cols[0] = (rng.random(n) < 0.1).astype(float)
        if make is not AverageCost:
            cols[-1] = np.where(rng.random(n) < gaps, math.nan, cols[-1])
        one, rows = make(), list(zip(*[c.tolist() for c in cols]))
        want = [one.step(*r) for r in rows]
        cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
        blocks = list(zip(cuts[:-1], cuts[1:]))
        if hasattr(one, "values"):
            got = make().values(*cols)
            assert np.allclose(np.array(want, float).T, np.array(got), rtol=1e-12, atol=1e-9, equal_nan=True)
        starts = [make() for _ in blocks]
        for level in range(one.levels):
            carried = make()
            for k, (a, b) in enumerate(blocks):
                for part in starts[k].parts[level] if one.levels > 1 else vars(starts[k]):
                    setattr(starts[k], part, copy.deepcopy(getattr(carried, part)))
                carried = copy.deepcopy(starts[k])
                carried.advance(level, copy.deepcopy(starts[k]).summary(level, *[c[a:b] for c in cols]))
        for start, (a, b) in zip(starts, blocks):
            again = [start.step(*r) for r in rows[a:b]]
            assert np.allclose(np.array(want[a:b], float), np.array(again, float), rtol=1e-12, atol=1e-9, equal_nan=True), (n, a, b)


def test_flat_market_rsi():
    r = R.Rsi(3)
    assert [r.step(5.0) for _ in range(4)][-1] == 100.0


def test_swing_patterns_against_full_history(spark, rows, bars):
    ids = ["fib_retrace_382", "fib_retrace_500", "fib_retrace_618", "fib_retrace_786", "elliott_w2_w3", "elliott_abc", "elliott_w4_w5", "harmonic_prz"]
    got = wide_signals(bars, ids, 10).where("symbol = 'AAAUSDT'").orderBy("t").toPandas()
    want = brute.swing_targets(series(rows))
    for i in ids:
        assert got[i].tolist() == want[i], i
    assert sum(map(abs, want["elliott_w2_w3"])) > 0


def test_every_strategy_is_registered_once():
    known = catalogue()
    assert len(known) == 101
    assert {k: len(v) for k, v in packs().items()} == {"OLD10": 10, "SR25": 25, "SR35": 35, "SWEEP": 20, "VISUAL": 28, "FIB": 9}
    with pytest.raises(KeyError):
        signals(None, ["no_such_strategy"])


@pytest.mark.parametrize("pair", [("sr_liquidity_sweep", "swp_range24_reclaim"), ("sr_pivot_breakout", "sr25_confirmed_pivot_breakout")])
def test_equal_rules_fire_equally(bars, pair):
    s = signals(bars, list(pair), 10).drop("strategy_id")
    assert s.count() > 0 and all(n == 2 for (n,) in s.groupBy("symbol", "t", "sig").count().select("count").collect())
