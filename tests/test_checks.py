"""Registered queries agree with their SQL on the smallest tables."""

from pathlib import Path

import pytest

from checks import load
from checks.compare import compare

SF = "/root/testdata/sf0.001"
NAMES = ["walk_bars", "quality_report", "coverage_gate", "recurrent_indicators", "feature_vector", "signals_range_sweeps", "signals_pending_confirmations",
         "signals_trailing_stops", "evaluated_strategies", "tuned_thresholds", "monthly_grades", "underlying_matrix", "execution_decisions",
         "arbitrated_intents", "paper_journal", "position_ledger", "fill_ledger"]


def test_names():
    reg = load()
    assert set(reg.ORACLES) <= set(reg.QUERIES) and len(reg.QUERIES) > 120


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")
def test_small_tables(spark):
    got = compare(spark, SF, NAMES)
    assert len(got) >= len(NAMES)
    bad = {k: v for k, v in got.items() if not v.startswith(("ok", "rows"))}
    assert not bad
