"""Retracement, wave and harmonic strategies from one pass over alternating swings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions.study import Study, _Make
from barlight.strategies.registry import TARGET, strategy
from barlight.strategies.steps import SWING_IDS, SwingPatterns

VER = "fib-ew-causal-v1"
# Display names and families, in the order of SWING_IDS.
NAMES = (
    ("Fibonacci Golden Pocket 0.618-0.670", "fibonacci"),
    ("Fibonacci Retracement 0.382 Reclaim", "fibonacci"),
    ("Fibonacci Retracement 0.500 Reclaim", "fibonacci"),
    ("Fibonacci Retracement 0.618 Reclaim", "fibonacci"),
    ("Fibonacci Retracement 0.786 Reclaim", "fibonacci"),
    ("Elliott Wave 2 to Wave 3", "elliott_wave"),
    ("Elliott Wave 4 to Wave 5", "elliott_wave"),
    ("Elliott ABC Completion Reversal", "elliott_wave"),
    ("Harmonic XABCD PRZ (Gartley/Bat/Butterfly/Crab)", "harmonic_fibonacci"),
)


def swing_targets(s: Study, hold: int = 12, pivots: int = 3, tag: str = "fx") -> list[str]:
    s.atr(14)
    s.pivot_marks(pivots, pivots)
    s.prior_high(3)
    s.prior_low(3)
    names = [f"{tag}_{i}" for i in SWING_IDS]
    s.scan(_Make(SwingPatterns, hold, pivots),
           [f"pvh_{pivots}_{pivots}", f"pvl_{pivots}_{pivots}", "rma_tr_14", "ph_h_3", "pl_l_3", "o", "h", "l", "c"], names)
    return names


def _target(id: str):
    def build(s: Study):
        swing_targets(s)
        return F.col(f"fx_{id}")
    return build


for _id, (_name, _family) in zip(SWING_IDS, NAMES):
    strategy(_id, _name, _family, VER, mode=TARGET)(_target(_id))
