"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is written to the ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barlight.session import local_session, prepare  # noqa: E402
from checks import load  # noqa: E402

QUERIES = (
    "walk_bars", "resample_many_timeframes", "quality_report", "moving_statistics", "recurrent_indicators", "feature_vector",
    "tuned_thresholds", "robustness_matrix", "flagship_channel_break", "evaluated_strategies", "range_reclaim_variants",
    "signals_trailing_stops", "signals_swing_patterns", "whole_catalogue_scan", "underlying_matrix", "execution_decisions",
    "paper_journal", "position_ledger",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(local_session(cpus, max(1, int(cpus)), "barlight-bench"))
    registry = load().QUERIES
    only = sys.argv[1:]
    registry["tick_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in QUERIES:
        if only and name not in only:
            continue
        t0 = time.time()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": Path(sf_dir).name.removeprefix("sf")}
    if "whole_catalogue_scan" in times:
        combos = 5 * 101
        out["combinations_per_second"] = round(combos / times["whole_catalogue_scan"], 1)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
