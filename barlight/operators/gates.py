"""Promotion gates, threshold tuning, monthly consistency, variant grids, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.operators import features as X
from barlight.operators import trades as T
from barlight.operators.bars import month_of, walk_forward_labels
from barlight.session import TIMEFRAME_MS, reliable_checkpoint

SERIES = ["symbol", "timeframe"]
HORIZONS = [3, 6, 12, 24]
# Fixed values: (fee, slippage) of the base and the stress scenario.
COSTS = {"base": (0.0004, 0.0001), "stress": (0.0005, 0.0003)}
MIN_SAMPLES = 30
# Horizon at which thresholds are tuned, in bars.
TUNED_HORIZON = 12
# Columns of feature rows that events and their outcomes read.
STUDIED = [*SERIES, "t", "i", "o", "c", "BOSStrength", "SweepDepth", "ReclaimQuality", "ExpansionVelocity", "p_depth", "p_dur", "wf", "wf_end"]


def _setups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in X.SETUPS], "kind string")


# --- promotion -------------------------------------------------------------------


def decide_promotion(stats: DataFrame, by: list[str], min_n: int = MIN_SAMPLES, min_exp: float = 0.0) -> DataFrame:
    """PASS, REJECT or INSUFFICIENT_DATA from the validation and holdout rows of ``stats``."""
    def at(window: str, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("wf") == window, F.col(col))), F.lit(0))

    pairs = stats.groupBy(*by, "kind").agg(
        at("validation", "n").alias("vn"), at("holdout", "n").alias("hn"),
        at("validation", "net_exp").alias("ve"), at("holdout", "net_exp").alias("he"))
    thin = (F.col("vn") < min_n) | (F.col("hn") < min_n)
    why = F.array_compact(F.array(
        F.when(thin, "minimum sample count not met in both validation and holdout"),
        F.when(~thin & (F.col("ve") <= min_exp), "validation net expectancy did not clear threshold"),
        F.when(~thin & (F.col("he") <= min_exp), "holdout net expectancy did not clear threshold")))
    status = F.when(thin, "INSUFFICIENT_DATA").when((F.col("ve") <= min_exp) | (F.col("he") <= min_exp), "REJECT").otherwise("PASS")
    return pairs.withColumns({"status": status, "reasons": why})


def placed_rows(rows: DataFrame, horizons: list[int]) -> DataFrame:
    """Feature rows with the bar before, paths and walk-forward windows: all that events are made of."""
    return walk_forward_labels(X.with_previous(X.with_paths(rows, horizons)))


def study_events(rows: DataFrame, horizons: list[int], config: dict | None = None) -> DataFrame:
    """Setup events with paths and walk-forward windows."""
    return X.detect_setups(placed_rows(rows, horizons), config)


def walk_forward_study(events: DataFrame, horizons: list[int], costs: dict = COSTS, rows: DataFrame | None = None) -> DataFrame:
    """Outcome summaries per window, horizon and cost, all setups present for each series of ``rows`` (by default: with an event)."""
    spark = events.sparkSession
    grid = spark.createDataFrame([(k, c) for k in horizons for c in costs], "horizon int, cost_name string")
    windows = spark.createDataFrame([("train",), ("validation",), ("holdout",)], "wf string")
    # Series times a fixed grid of 3 setups, 3 windows and the given horizons and costs.
    every = ((events if rows is None else rows).select(*SERIES).distinct().crossJoin(F.broadcast(_setups(spark)))
             .crossJoin(F.broadcast(windows)).crossJoin(F.broadcast(grid)))
    return X.summarize(X.outcomes(events, horizons, costs), [*SERIES, "kind", "wf", "horizon", "cost_name"], every)


def robustness_matrix(rows: DataFrame, horizons: list[int] = HORIZONS, costs: dict = COSTS,
                      config: dict | None = None, min_n: int = MIN_SAMPLES, min_exp: float = 0.0, tune: bool = True) -> DataFrame:
    """A setup passes only if every horizon and cost run passes.

    Each series' thresholds are first tuned on its own train window; ``config`` stands
    above what was tuned, and ``tune=False`` keeps the fixed thresholds. The feature
    rows are written once: tuning, events and the grid of groups all read that.
    """
    if tune:
        paths = sorted({*horizons, TUNED_HORIZON})
        placed = reliable_checkpoint(placed_rows(rows, paths).select(*STUDIED, *[f"{x}{k}" for k in paths for x in ("x", "hi", "lo")]))
        tuned = tuned_on(placed, TUNED_HORIZON, *COSTS["base"], min_n)
        events = X.detect_setups(placed, config, thresholds_of(tuned))
    else:
        placed, events = None, study_events(rows, horizons, config)
    stats = walk_forward_study(events, horizons, costs, placed)
    runs = decide_promotion(stats, [*SERIES, "horizon", "cost_name"], min_n, min_exp)
    status = F.when(F.bool_or(F.col("status") == "INSUFFICIENT_DATA"), "INSUFFICIENT_DATA").when(
        F.bool_or(F.col("status") != "PASS"), "REJECT").otherwise("PASS")
    out = runs.groupBy(*SERIES, "kind").agg(
        status.alias("status"), F.count_if(F.col("status") == "PASS").alias("passed_runs"), F.count("*").alias("total_runs"))
    reason = (F.when(F.col("status") == "INSUFFICIENT_DATA", "at least one horizon/cost window lacks minimum samples")
              .when(F.col("status") == "REJECT", "setup failed at least one horizon/cost stress run").otherwise(""))
    return out.withColumn("reason", reason)


def acceptance_report(quality: DataFrame, matrix: DataFrame) -> DataFrame:
    """One verdict per series: data quality first, then what could be promoted."""
    found = matrix.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "PASS", F.col("kind")))).alias("promotable"))
    joined = quality.select(*SERIES, F.col("pass").alias("quality_pass")).join(found, SERIES, "left")
    promotable = F.when(F.col("quality_pass"), F.coalesce("promotable", F.array().cast("array<string>"))).otherwise(
        F.array().cast("array<string>"))
    verdict = F.when(~F.col("quality_pass"), "DATA_QUALITY_FAIL").when(
        F.size(promotable) > 0, "PROMOTABLE_SETUP_FOUND").otherwise("NO_PROMOTABLE_SETUP")
    return joined.select(*SERIES, "quality_pass", promotable.alias("promotable"), verdict.alias("verdict"))


# Tuning grids.
GRID_BREAKOUT = [0.15, 0.2, 0.3, 0.45, 0.65, 0.9]
GRID_SWEEP = [0.08, 0.12, 0.18, 0.25, 0.35, 0.5]
GRID_RECLAIM = [0.03, 0.05, 0.08, 0.12, 0.2, 0.3]
GRID_DEPTH = [0.1, 0.18, 0.25, 0.35, 0.45]
GRID_DURATION = [0.15, 0.25, 0.4, 0.55]
GRID_EXPANSION = [1.05, 1.2, 1.4, 1.7, 2.1]


def tuning_grid(spark: SparkSession) -> DataFrame:
    """All grid points (142 rows), numbered in search order per setup; ``ia, ib, id`` index the lists."""
    points = [("breakout", i, a, None, None, i, None, None) for i, a in enumerate(GRID_BREAKOUT)]
    points += [("liquidity_sweep_reclaim", 6 * i + j, a, b, None, i, j, None)
               for i, a in enumerate(GRID_SWEEP) for j, b in enumerate(GRID_RECLAIM)]
    points += [("compression_release", 20 * i + 5 * j + k, a, b, d, i, j, k)
               for i, a in enumerate(GRID_DEPTH) for j, b in enumerate(GRID_DURATION) for k, d in enumerate(GRID_EXPANSION)]
    return spark.createDataFrame(
        points, "kind string, point int, ga double, gb double, gd double, ia int, ib int, id int")


def tune_thresholds(rows: DataFrame, horizon: int = 12, fee: float = 0.0004, slip: float = 0.0001,
                    min_n: int = MIN_SAMPLES) -> DataFrame:
    """Best grid point per series and setup on the train window.

    Enough samples beat too few, then expectancy, then count, then the earliest point.
    """
    return tuned_on(placed_rows(rows, [horizon]), horizon, fee, slip, min_n)


def thresholds_of(tuned: DataFrame) -> DataFrame:
    """A row a series with its tuned numbers by name."""
    of = {"breakoutStrength": ("breakout", "ga"), "sweepStrength": ("liquidity_sweep_reclaim", "ga"), "reclaimStrength": ("liquidity_sweep_reclaim", "gb"),
          "compressionDepth": ("compression_release", "ga"), "compressionDuration": ("compression_release", "gb"), "expansionVelocity": ("compression_release", "gd")}
    return tuned.groupBy(*SERIES).agg(*[F.max(F.when(F.col("kind") == kind, F.col(g))).alias(name) for name, (kind, g) in of.items()])


def tuned_on(placed: DataFrame, horizon: int, fee: float, slip: float, min_n: int) -> DataFrame:
    """:func:`tune_thresholds` of :func:`placed_rows`."""
    spark = placed.sparkSession
    cand = X.outcomes(X.candidates(placed.where(F.col("wf") == "train")), [horizon], {"base": (fee, slip)})
    # Events first fold into the cells between thresholds; only cells meet the grid.
    steps = {"breakout": (GRID_BREAKOUT,), "liquidity_sweep_reclaim": (GRID_SWEEP, GRID_RECLAIM),
             "compression_release": (GRID_DEPTH, GRID_DURATION, GRID_EXPANSION)}

    def cell(k: int, x: str) -> Column:
        out = F.lit(0)
        for kind, lists in steps.items():
            if k < len(lists):
                passed = sum((F.when(F.col(x) >= v, 1).otherwise(0) for v in lists[k]), F.lit(0))
                out = F.when(F.col("kind") == kind, passed).otherwise(out)
        return out

    cells = cand.select(*SERIES, "kind", cell(0, "a").alias("ca"), cell(1, "b").alias("cb"), cell(2, "d").alias("cd"), "net").groupBy(
        *SERIES, "kind", "ca", "cb", "cd").agg(F.count("*").alias("n"), F.sum("net").alias("s"))
    grid = F.broadcast(tuning_grid(spark))
    ok = (F.col("ca") > F.col("ia")) & (F.col("ib").isNull() | (F.col("cb") > F.col("ib"))) & (
        F.col("id").isNull() | (F.col("cd") > F.col("id")))
    scored = cells.join(grid, "kind").where(ok).groupBy(*SERIES, "kind", "point").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("net_exp"))
    every = placed.select(*SERIES).distinct().crossJoin(grid)
    full = every.join(scored, [*SERIES, "kind", "point"], "left").na.fill(0, ["n"]).na.fill(0.0, ["net_exp"])
    # Sums of the same events in another order may differ in the last bits; they tie.
    best = Window.partitionBy(*SERIES, "kind").orderBy(
        F.desc(F.col("n") >= min_n), F.desc(F.round("net_exp", 12)), F.desc("n"), "point")
    return (full.withColumn("rk", F.row_number().over(best)).where("rk = 1")
            .select(*SERIES, "kind", "point", "ga", "gb", "gd", "n", "net_exp"))


# --- monthly consistency -----------------------------------------------------------


def month_coverage(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows and coverage of each series in each window, missing months included.

    ``windows`` are calendar months for all series, or each series' own (``series_months``).
    """
    sizes = F.create_map(*[F.lit(x) for kv in TIMEFRAME_MS.items() for x in kv])
    counts = bars.groupBy(*SERIES, month_of(F.col("t")).alias("month")).agg(F.count("*").alias("rows"))
    own = set(SERIES) <= set(windows.columns)
    grid = windows if own else bars.select(*SERIES).distinct().crossJoin(F.broadcast(windows))
    full = grid.join(counts, [*SERIES, "month"], "left").na.fill(0, ["rows"])
    expected = F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / sizes[F.col("timeframe")]))
    return full.withColumn("coverage", F.least(F.lit(1.0), F.col("rows") / expected))


def with_month_part(bars: DataFrame, covered: DataFrame, min_coverage: float) -> DataFrame:
    """Bars of the covered months with the month as an extra series key.

    Every window then restarts its warm-up in each month.
    """
    ok = covered.where(F.col("coverage") >= min_coverage).select(*SERIES, F.col("month").alias("part"))
    return bars.withColumn("part", month_of(F.col("t"))).join(ok, [*SERIES, "part"], "left_semi")


def monthly_eval_sliced(bars: DataFrame, windows: DataFrame, ids: list[str], least: int,
                        min_coverage: float = 0.98, longest: int | None = None) -> DataFrame:
    """Every strategy on each month's bars alone."""
    from barlight.strategies.registry import signals

    covered = month_coverage(bars, windows)
    part = with_month_part(bars, covered, min_coverage)
    spans = covered.select(*SERIES, F.col("month").alias("part"), "start", "end")
    made = T.trades(signals(part, ids, longest), T.last_bars(part)).join(spans, [*SERIES, "part"]).where(
        F.col("entry_t") >= F.col("start"))
    by = [*SERIES, "strategy_id", "part"]
    rows = T.evaluate(made, F.col("start"), F.col("end"), [*by, "start", "end"], least=F.lit(least)).drop("start", "end")
    spark = bars.sparkSession
    eligible = (covered.where(F.col("coverage") >= min_coverage).select(*SERIES, F.col("month").alias("part"))
                .crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in ids], "strategy_id string"))))
    return (eligible.join(rows, by, "left").withColumn("pass", F.coalesce("pass", F.lit(False)))
            .na.fill(0).withColumnRenamed("part", "month"))


def monthly_eval_stream(trades: DataFrame, covered: DataFrame, strategy_keys: DataFrame, least: int,
                        min_coverage: float = 0.98) -> DataFrame:
    """One full-history trade list, attributed to entry months.

    ``strategy_keys`` lists (symbol, timeframe, strategy_id), so months without
    trades appear too.
    """
    month = month_of(F.col("entry_t"))
    spans = covered.select(*SERIES, "month", "start", "end", "coverage")
    placed = trades.withColumn("month", month).join(spans, [*SERIES, "month"]).where(
        (F.col("entry_t") >= F.col("start")) & (F.col("entry_t") < F.col("end")) & (F.col("coverage") >= min_coverage))
    by = [*SERIES, "strategy_id", "month"]
    rows = T.evaluate(placed, F.col("start"), F.col("end"), [*by, "start", "end"], least=F.lit(least), clamp_low=True)
    full = strategy_keys.join(spans, SERIES).join(rows.drop("start", "end"), by, "left")
    eligible = F.col("coverage") >= min_coverage
    return full.withColumn("pass", F.coalesce("pass", F.lit(False)) & eligible).na.fill(0).select(
        *by, "coverage", eligible.alias("eligible"), "n", "net", "net15", "pf", "dd", "exp", "posseg", "pass")


def monthly_counts(monthly: DataFrame, by: list[str]) -> DataFrame:
    """Eligible, passing, positive and stress-positive months per key."""
    e = F.col("eligible") if "eligible" in monthly.columns else F.lit(True)
    return monthly.groupBy(*by).agg(
        F.count_if(e).alias("eligible_months"), F.count_if(e & F.col("pass")).alias("pass_months"),
        F.count_if(e & (F.col("net") > 0)).alias("positive_months"),
        F.count_if(e & (F.col("net15") > 0)).alias("stress_positive_months"))


def monthly_grade(counts: DataFrame) -> DataFrame:
    n, p = F.col("eligible_months"), F.col("pass_months")
    ratio = F.when(n > 0, p / n).otherwise(0.0)
    grade = (F.when((n >= 9) & (p >= 9), "A_9_OF_9").when((n >= 9) & (p >= 8), "B_8_OF_9")
             .when((n >= 6) & (ratio >= 0.80), "C_80PCT_SHORTER").otherwise("REVIEW"))
    return counts.withColumns({"pass_ratio": ratio, "grade": grade})


def year_grade(counts: DataFrame, extended: bool = False) -> DataFrame:
    """All months, one miss, or review; ``extended`` splits the review by stress result."""
    n, p = F.col("eligible_months"), F.col("pass_months")
    grade = F.when((n >= 9) & (p == n), "A_ALL_MONTHS").when((n >= 9) & (p == n - 1), "B_ONE_MISS")
    if extended:
        grade = grade.when((n >= 6) & (F.col("net15") > 0) & (F.col("pf") > 1.05), "C_POSITIVE_REVIEW").otherwise("FAIL_REVIEW")
    else:
        grade = grade.otherwise("REVIEW")
    return counts.withColumn("year_grade", grade)


def accepted(graded: DataFrame, extended: bool = False) -> DataFrame:
    """Accepted combinations in board order."""
    ok = F.col("year_grade") != "FAIL_REVIEW" if extended else F.col("year_grade").isin("A_ALL_MONTHS", "B_ONE_MISS")
    # The grade names sort in rank order.
    return graded.where(ok).orderBy("year_grade", F.desc("pass_months"), F.desc("net15"), F.desc("pf"), F.desc("n"),
                                    "symbol", "timeframe", "strategy_id")


def accepted_counts(graded: DataFrame) -> DataFrame:
    """How many combinations earned each grade, per timeframe."""
    return graded.groupBy("timeframe", "grade").agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"))


# --- variants and recovery ----------------------------------------------------------

# Default grid of the range sweep and its baseline.
RANGE_GRID = {"lookback": [24, 36, 48, 64, 96], "thresholdAtr": [0.03, 0.05, 0.08, 0.12], "bodyConfirm": [False, True],
              "wickRatio": [0.0, 1.5], "minBarRangeAtr": [0.0], "directionMode": ["both"]}
RANGE_BASE = {"lookback": 48, "thresholdAtr": 0.05, "bodyConfirm": False, "wickRatio": 0.0, "minBarRangeAtr": 0.0,
              "directionMode": "both"}
_TYPES = {"lookback": "int", "thresholdAtr": "double", "bodyConfirm": "boolean", "wickRatio": "double",
          "minBarRangeAtr": "double", "directionMode": "string"}


def build_variants(spark: SparkSession, grid: dict | None = None, baseline: dict | None = None,
                   atr_period: int = 14) -> DataFrame:
    """Cartesian grid of range-sweep parameters with the baseline marked or added."""
    lists, base = {**RANGE_GRID, **(grid or {})}, {**RANGE_BASE, **(baseline or {})}
    df = spark.range(1).select()
    for name, kind in _TYPES.items():
        values = F.array(*[F.lit(x).cast(kind) for x in lists[name]])
        df = df.withColumn(name, F.explode(F.array_distinct(values)))
    one = spark.range(1).select(*[F.lit(base[n]).cast(k).alias(n) for n, k in _TYPES.items()])
    both = df.withColumn("baseline", F.lit(False)).unionByName(one.withColumn("baseline", F.lit(True)))
    rows = both.groupBy(*_TYPES).agg(F.max("baseline").alias("baseline")).withColumn("atrPeriod", F.lit(atr_period))

    def key(c: str) -> Column:
        whole = F.col(c) == F.floor(c)
        text = F.when(whole, F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
        return F.replace(F.replace(text, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))

    vid = F.concat_ws("__", F.lit("range_reclaim"), F.concat(F.lit("p"), F.col("lookback").cast("string")),
                      F.concat(F.lit("t"), key("thresholdAtr")), F.concat(F.lit("b"), F.col("bodyConfirm").cast("int")),
                      F.concat(F.lit("w"), key("wickRatio")), F.concat(F.lit("r"), key("minBarRangeAtr")),
                      F.concat(F.lit("d"), "directionMode"))
    params = F.struct(*_TYPES, "atrPeriod")
    return rows.withColumns({"variantId": vid, "fingerprint": F.sha2(F.to_json(params), 256)})


def holdout_split(monthly: DataFrame, by: list[str], holdout: int) -> DataFrame:
    """Label the last ``holdout`` eligible months of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc("month"))
    return monthly.where("eligible").withColumn(
        "split", F.when(F.row_number().over(w) <= holdout, "holdout").otherwise("discovery"))


def annotate_recovery(monthly: DataFrame, variants: DataFrame, holdout: int = 0) -> DataFrame:
    """Compare each variant's months with the baseline variant's, per series.

    ``monthly`` has (symbol, timeframe, variantId, month, eligible, pass).
    """
    by = [*SERIES, "variantId"]
    rows = monthly.join(variants.select("variantId", "baseline"), "variantId")
    base = rows.where("baseline").groupBy(*SERIES, "month").agg(
        F.max(F.when(F.col("eligible") & F.col("pass"), 1).otherwise(0)).alias("base_pass"),
        F.max(F.when(F.col("eligible"), 1).otherwise(0)).alias("base_eligible"))
    w = Window.partitionBy(*by).orderBy(F.desc(F.col("eligible").cast("int")), F.desc("month"))
    held = rows.withColumn("_h", F.col("eligible") & (F.row_number().over(w) <= holdout))
    joined = held.join(base, [*SERIES, "month"], "left")
    s = joined.groupBy(*by, "baseline").agg(
        F.count_if(F.col("eligible")).alias("eligible_months"),
        F.count_if(F.col("eligible") & F.col("pass")).alias("pass_months"),
        F.count_if(F.col("_h")).alias("holdout_months"), F.count_if(F.col("_h") & F.col("pass")).alias("holdout_pass"),
        F.max("base_pass").isNotNull().alias("has_base"),
        F.sum("base_pass").alias("base_pass_months"), F.sum("base_eligible").alias("base_eligible_months"),
        F.coalesce(F.bool_and((F.col("base_pass") == 0) | F.col("pass")), F.lit(False)).alias("preserves"))
    near = (F.col("base_eligible_months") >= 2) & (F.col("base_pass_months") == F.col("base_eligible_months") - 1)
    full = (F.col("eligible_months") > 0) & (F.col("pass_months") == F.col("eligible_months"))
    cand = ~F.col("baseline") & near & full & F.col("preserves")
    held_ok = F.col("holdout_pass") == F.col("holdout_months")
    status = (F.when(~F.col("has_base"), "NO_BASELINE")
              .when(F.col("baseline"), F.when(near, "BASELINE_NEAR_PASS").otherwise("BASELINE"))
              .when(cand & held_ok, "VALIDATED_RECOVERY").when(cand, "RECOVERY_CANDIDATE")
              .when(full, "FULL_PASS").otherwise("OTHER"))
    return s.withColumns({"delta_pass_months": F.col("pass_months") - F.col("base_pass_months"),
                          "recovery_status": status})


# --- near-pass, tuning over suffixes, parity, audits ----------------------------------


def near_pass_baseline(seeds: DataFrame, results: DataFrame, failures: DataFrame, monthly: DataFrame) -> DataFrame:
    """Seeds with their long-history result, failed months and lifetime class."""
    key = [*SERIES, "strategy_id"]
    months = monthly.where((F.col("days") >= 20) & (F.col("coverage") >= 0.98)).groupBy(*key).agg(
        F.count("*").alias("eligible_months"), F.count_if(F.col("pass")).alias("pass_months"),
        F.sort_array(F.collect_list(F.when(~F.col("pass"), F.col("month")))).alias("failed_months"))
    rows = (seeds.join(results.select(*key, "history_days", "net", "pf", "dd", "n"), key, "left")
            .join(failures.select(*SERIES, F.col("reason").alias("failure")), SERIES, "left")
            .join(months, key, "left").na.fill(0, ["eligible_months", "pass_months"]))
    none = F.col("net").isNull()
    status = (F.when(none, F.when(F.col("failure") == "TOO_SHORT_HISTORY", "SHORT_HISTORY")
                     .when(F.col("failure") == "PARTIAL_LIFETIME_COVERAGE", "DATA_GAP")
                     .when(F.col("failure") == "ERROR", "ERROR").otherwise("NO_RESULT"))
              .when(F.col("history_days") < 180, "YOUNG_COIN")
              .when(F.col("history_days") < 540, "SHORTER_LISTING_HISTORY").otherwise("FULL_HISTORY"))
    e, p = F.col("eligible_months"), F.col("pass_months")
    kind = F.when(~none, F.when(e == 0, "NO_ELIGIBLE_MONTHS").when(p == e, "ALL_MONTHS_PASS")
                  .when(p == e - 1, "ONE_MONTH_SHORT").when(p / e >= 0.8, "GE80PCT").otherwise("BELOW80PCT"))
    return rows.withColumns({"status": status, "consistency": kind,
                             "pass_ratio": F.when(e > 0, p / e).otherwise(0.0)})


def suffix_summaries(monthly: DataFrame, by: list[str], suffixes: list[int] = [12, 9, 6, 3]) -> DataFrame:  # noqa: B006
    """Compounded net and pass counts over the last k months of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc("month"))
    ranked = monthly.withColumn("rk", F.row_number().over(w))
    spread = ranked.withColumn("last", F.explode(F.array(*[F.lit(k) for k in suffixes]))).where("rk <= last")
    return spread.groupBy(*by, "last").agg(
        F.count("*").alias("months"), F.sum("n").alias("trades"), (F.product(1 + F.col("net")) - 1).alias("net"),
        F.count_if(F.col("net") > 0).alias("positive"), F.count_if(F.col("pass")).alias("passed"), F.max("dd").alias("dd"))


def tuning_deltas(summary: DataFrame, by: list[str], config: str, baseline: str) -> DataFrame:
    """Each configuration against the baseline configuration of the same key."""
    base = summary.where(F.col(config) == baseline).select(
        *by, "last", F.col("net").alias("base_net"), F.col("positive").alias("base_positive"), F.col("dd").alias("base_dd"))
    return summary.join(base, [*by, "last"], "left").withColumns({
        "delta_net": F.col("net") - F.col("base_net"), "delta_positive": F.col("positive") - F.col("base_positive"),
        "delta_dd": F.col("dd") - F.col("base_dd")})


def top_configs(deltas: DataFrame, by: list[str], config: str, k: int = 10) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("positive"), F.desc("net"), "dd", config)
    return deltas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def common_configs(deltas: DataFrame, config: str) -> DataFrame:
    """Medians over candidates for each configuration."""
    return deltas.groupBy(config, "last").agg(
        F.count("*").alias("candidates"), F.percentile("net", 0.5).alias("median_net"),
        F.percentile("dd", 0.5).alias("median_dd"), F.percentile("delta_net", 0.5).alias("median_delta"),
        F.count_if(F.col("net") > 0).alias("positive_candidates"))


def metric_parity(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tol: float = 1e-9) -> DataFrame:
    """Rows of two runs side by side; the row with most trades (then the greatest metrics) stands for a key."""
    def one(df: DataFrame, tag: str) -> DataFrame:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*metrics), F.struct("n", *metrics)).alias(tag))
        return picked

    both = one(a, "x").join(one(b, "y"), keys, "full")
    same = F.lit(True)
    for m in metrics:
        x, y = F.col(f"x.{m}"), F.col(f"y.{m}")
        scale = F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        same = same & (F.abs(x - y) <= tol * scale)
    status = (F.when(F.col("x").isNull(), "MISSING_LEFT").when(F.col("y").isNull(), "MISSING_RIGHT")
              .when(same, "MATCH").otherwise("DIFFERENT"))
    return both.withColumn("status", status)


def exit_month_grade(runs: DataFrame, monthly: DataFrame, by: list[str]) -> DataFrame:
    """Full pass with nine (A) or eight (B) passing months, else rejected; A first, then net."""
    counts = monthly.groupBy(*by).agg(F.count_if(F.col("pass")).alias("pass_months"), F.count("*").alias("months"))
    p = F.col("pass_months")
    grade = F.when(F.col("pass") & (p == 9), "A_9_OF_9").when(F.col("pass") & (p == 8), "B_8_OF_9").otherwise("REJECT")
    out = runs.join(counts, by, "left").na.fill(0, ["pass_months", "months"]).withColumn("grade", grade)
    return out


def _prefix_signals(bars: DataFrame, cuts: list[int], ids: list[str] | None, longest: int | None) -> tuple[DataFrame, DataFrame]:
    """Signals on each prefix, and those of the full run up to each cut. The prefix is one more part of the series key, so all run at once."""
    from barlight.strategies.registry import signals

    cut = F.explode(F.array(*[F.lit(c).cast("long") for c in cuts]))
    prefixes = bars.withColumn("_cut", cut).where(F.col("t") <= F.col("_cut")).withColumn(
        "part", F.col("_cut").cast("string")).drop("_cut")
    cols = ["symbol", "timeframe", "strategy_id", "cut", "t", "sig"]
    part = signals(prefixes, ids, longest).withColumn("cut", F.col("part").cast("long")).select(*cols)
    full = signals(bars, ids, longest).withColumn("cut", cut).where(F.col("t") <= F.col("cut")).select(*cols)
    return part, full


def causality_audit(bars: DataFrame, cuts: list[int], ids: list[str] | None, longest: int | None = None) -> DataFrame:
    """Signals on prefixes that the full run does not have, and the other way round.

    An empty result means no strategy looks ahead.
    """
    part, full = _prefix_signals(bars, cuts, ids, longest)
    lost = full.exceptAll(part).withColumn("kind", F.lit("LOST"))
    extra = part.exceptAll(full).withColumn("kind", F.lit("EXTRA"))
    return lost.unionByName(extra)


def causality_counts(bars: DataFrame, cuts: list[int], ids: list[str] | None = None, longest: int | None = None) -> DataFrame:
    """Per strategy and cut: signals on the prefix, and how many of either run the other does not have."""
    part, full = _prefix_signals(bars, cuts, ids, longest)
    tagged = part.withColumns({"p": F.lit(1), "f": F.lit(0)}).unionByName(full.withColumns({"p": F.lit(0), "f": F.lit(1)}))
    met = tagged.groupBy("symbol", "timeframe", "strategy_id", "cut", "t", "sig").agg(F.sum("p").alias("p"), F.sum("f").alias("f"))
    return met.groupBy("strategy_id", "cut").agg(F.sum("p").alias("n"), F.sum(F.greatest(F.col("f") - F.col("p"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("p") - F.col("f"), F.lit(0))).alias("extra"))
