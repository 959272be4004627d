"""Strategy signals on walk bars, grouped by the state they need."""

from __future__ import annotations

from barlight.strategies.registry import signals
from checks import strategy_sql as S
from checks.base import bars, bound, check

GROUPS = {
    "signals_range_sweeps": (list(S.SWEEP_RULES), S.SWEEPS_SQL),
    "signals_calendar_levels": (list(S.CALENDAR_RULES), S.CALENDAR_SQL),
    "signals_pivots_profiles": (list(S.LEVEL_RULES), S.LEVELS_SQL),
    "signals_pending_confirmations": (list(S.PENDING_COLUMNS), S.PENDING_SQL),
    "signals_zones_gaps": (list(S.ZONE_COLUMNS), S.ZONES_SQL),
    "signals_pivot_lists_vwap": (["sr25_fractal_cluster_rejection", "sr25_trendline_breakout", "sr25_swing_anchored_vwap",
                                  "vis_structure_vwap"], S.CLUSTER_SQL),
    "signals_trailing_stops": (list(S.TRAILING_RULES), S.TRAILING_SQL),
    "signals_chart_shapes": (list(S.SHAPE_RULES), S.SHAPES_SQL),
    "signals_oscillators": (list(S.OSC_RULES), S.OSC_SQL),
    "signals_momentum_filter": (["ssl_hybrid_qqe_flip", "chandelier_zlsma"], S.MOMENTUM_SQL),
    "signals_order_blocks": (["sr25_lsob", "sr25_kernel_supply_demand"], S.BLOCKS_SQL),
    "signals_swing_patterns": (list(S.SWING_RULES), S.SWINGS_SQL),
}


def _group(ids):
    return lambda spark, sf: signals(bars(spark, sf), ids, bound(spark, sf)).select("symbol", "timeframe", "strategy_id", "t", "sig")


for _name, (_ids, _sql) in GROUPS.items():
    check(_name, _sql)(_group(_ids))
