"""The strategy catalogue: how one is declared, and running many over bars.

A strategy is a function of a :class:`Study` that declares the columns it reads
and returns its signal column (1 long, -1 short, 0 none).  ``REVERSAL``
strategies mark flips; ``TARGET_POSITION`` strategies give the wanted position
of every bar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.functions.study import Study
from barlight.operators import layout as L

REVERSAL, TARGET = "REVERSAL", "TARGET_POSITION"


@dataclass(frozen=True)
class Strategy:
    id: str
    name: str
    family: str
    version: str
    mode: str
    build: Callable[[Study], Column]


CATALOGUE: dict[str, Strategy] = {}


def strategy(id: str, name: str, family: str, version: str, mode: str = REVERSAL):
    """Register a column builder; the function itself stays usable."""
    def add(fn: Callable[[Study], Column]) -> Callable[[Study], Column]:
        CATALOGUE[id] = Strategy(id, name, family, version, mode, fn)
        return fn
    return add


def catalogue() -> dict[str, Strategy]:
    from barlight.strategies import core, levels, sweeps, swings, visual  # noqa: F401  (they register)

    return CATALOGUE


def pick(ids: Iterable[str] | None) -> list[Strategy]:
    known = catalogue()
    if ids is None:
        return list(known.values())
    wanted = list(ids)
    missing = [i for i in wanted if i not in known]
    if missing:
        raise KeyError(f"unknown strategies: {missing}")
    return [known[i] for i in wanted]


# Warm-up bars, convergence class and anchor where they are stated.
CONVERGENCE = {
    "sr25_trendline_breakout": (100, "ANCHORED", "DATASET_START"),
    "sr25_fvg_first_touch": (50, "ANCHORED", "DATASET_START"),
    "sr_liquidity_sweep": (40, "BOUNDED_WINDOW", None),
    "sr25_poc_mean_reversion": (80, "ANCHORED", "UTC_SESSION"),
    "sr25_camarilla_h3_l3": (80, "ANCHORED", "PREVIOUS_UTC_DAY"),
    "sr_range_edge": (80, "BOUNDED_WINDOW", None),
    "sr25_impulse_ob_retest": (60, "BOUNDED_WINDOW", None),
}
DEFAULT_CONVERGENCE = (100, "ANCHORED", "DATASET_START")
SR_OLD = ("sr_pivot_bounce", "sr_pivot_breakout", "sr_break_retest", "sr_wick_rejection", "sr_liquidity_sweep",
          "sr_range_edge", "sr_prior_day_sweep", "sr_level_flip", "sr_compression_breakout", "sr_volume_breakout")


def packs() -> dict[str, list[str]]:
    """Named groups of strategies."""
    ids = list(catalogue())
    sr25 = [i for i in ids if i.startswith("sr25_")]
    return {
        "OLD10": list(SR_OLD), "SR25": sr25, "SR35": [*SR_OLD, *sr25],
        "SWEEP": [i for i in ids if i.startswith("swp_")], "VISUAL": [i for i in ids if i.startswith("vis_")],
        "FIB": [i for i in ids if i.startswith(("fib_", "elliott_", "harmonic_"))],
    }


def registry_frame(spark: SparkSession) -> DataFrame:
    """Identity and convergence data of every strategy."""
    rows = [(s.id, s.name, s.family, s.version, s.mode, *CONVERGENCE.get(s.id, DEFAULT_CONVERGENCE))
            for s in catalogue().values()]
    return spark.createDataFrame(
        rows, "strategy_id string, name string, family string, version string, mode string, warmup_bars int, "
              "convergence string, anchor string")


def sided(long: Column, short: Column) -> Column:
    """Long wins over short; an undefined condition is false."""
    return F.when(long, 1).when(short, -1).otherwise(0)


def wide_signals(bars: DataFrame, ids: Iterable[str] | None = None, longest: int | None = None,
                 block_rows: int = L.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Bars with one integer column per strategy, and the next bar's open and time."""
    chosen = pick(ids)
    study = Study.for_bars(bars, L.longest_series(bars) if longest is None else longest, block_rows)
    study.next_open()
    columns = {s.id: s.build(study) for s in chosen}
    frame = study.frame().withColumns({k: v.cast("int") for k, v in columns.items()})
    keep = [c for c in ("symbol", "timeframe", "part", L.BLOCK) if c in frame.columns]
    return frame.select(*keep, "t", "next_t", "next_o", *columns)


def signals(bars: DataFrame, ids: Iterable[str] | None = None, longest: int | None = None,
            block_rows: int = L.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Sparse long form: one row per strategy and bar that matters.

    Reversal strategies keep their non-zero bars.  Target strategies keep
    non-zero bars and the zero bar that ends a position.
    """
    chosen = pick(ids)
    wide = wide_signals(bars, [s.id for s in chosen], longest, block_rows)
    targets = [s.id for s in chosen if s.mode == TARGET]
    if targets:
        if L.BLOCK in wide.columns:
            by = [c for c in ("symbol", "timeframe", "part") if c in wide.columns]
            wide = L.neighbour(wide, by, "t", {f"_p_{s}": s for s in targets}, L.BLOCK)
        else:
            w = L.series_window(wide)
            wide = wide.withColumns({f"_p_{s}": F.lag(s).over(w) for s in targets})
    cells = [
        F.struct(F.lit(s.id).alias("strategy_id"), F.lit(s.mode).alias("mode"), F.col(s.id).alias("sig"),
                 (F.col(s.id) != 0 if s.mode == REVERSAL
                  else (F.col(s.id) != 0) | F.coalesce(F.col(f"_p_{s.id}") != 0, F.lit(False))).alias("keep"))
        for s in chosen
    ]
    keys = [c for c in ("symbol", "timeframe", "part", L.BLOCK) if c in wide.columns]
    cell = F.explode(F.filter(F.array(*cells), lambda x: x["keep"]))
    return wide.select(*keys, "t", "next_t", "next_o", cell.alias("_c")).select(
        *keys, F.col("_c.strategy_id").alias("strategy_id"), F.col("_c.mode").alias("mode"), "t",
        F.col("_c.sig").alias("sig"), "next_t", "next_o")


# --- patterns shared by many strategies ---------------------------------------


def cross_over(s: Study, a: str, b: str) -> Column:
    return (s.lag(a) <= s.lag(b)) & (F.col(a) > F.col(b))


def cross_under(s: Study, a: str, b: str) -> Column:
    return (s.lag(a) >= s.lag(b)) & (F.col(a) < F.col(b))


def crosses(s: Study, a: str, b: str) -> Column:
    return sided(cross_over(s, a, b), cross_under(s, a, b))


def confirm_within(s: Study, tag: str, long: Column, short: Column, level_long: Column, level_short: Column,
                   deps: list[str], ok_long: Callable[[Column], Column], ok_short: Callable[[Column], Column],
                   bars: int, confirm_deps: list[str] = (), same_bar: bool = False) -> Column:
    """A trigger, then the first confirming bar among the next ``bars``.

    A later trigger replaces a pending one.  Every frame reaches back ``bars``
    rows at most, so no running state is needed.
    """
    i = s.index()
    deps = [*deps, L.INDEX]
    side = s.row(f"{tag}_side", F.when(long, 1).when(short, -1), deps)
    s.row(f"{tag}_lvl", F.when(side == 1, level_long).when(side == -1, level_short), [f"{tag}_side", *deps])
    s.row(f"{tag}_mark", F.when(side.isNotNull(), F.struct(i.alias("at"), side.alias("side"),
                                                        F.col(f"{tag}_lvl").alias("lvl"))), [f"{tag}_lvl"])
    end = 0 if same_bar else -1
    s.window(f"{tag}_pend", lambda w: F.last(f"{tag}_mark", ignorenulls=True).over(w.rowsBetween(-bars, end)),
             [f"{tag}_mark"], back=bars)
    pend = F.col(f"{tag}_pend")
    free = F.lit(True) if same_bar else side.isNull()
    level = pend["lvl"]
    hit = free & (((pend["side"] == 1) & ok_long(level)) | ((pend["side"] == -1) & ok_short(level)))
    s.row(f"{tag}_hit", F.when(hit, i), [f"{tag}_pend", *confirm_deps])
    s.window(f"{tag}_used", lambda w: F.max(f"{tag}_hit").over(w.rowsBetween(-bars, -1)), [f"{tag}_hit"], back=bars)
    used = F.col(f"{tag}_used")
    taken = used >= pend["at"] if same_bar else used > pend["at"]
    first = F.col(f"{tag}_hit").isNotNull() & ~F.coalesce(taken, F.lit(False))
    return F.when(first, pend["side"]).otherwise(0)
