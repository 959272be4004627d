"""The eighteen-feature vector, setup events, and the event study on them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.functions.study import Study
from barlight.operators import layout as L

FEATURES = (
    "InternalStructure", "ExternalStructure", "BOSStrength", "CHOCHStrength", "SwingQuality", "RangeBoundary",
    "BreakoutDisplacement", "LiquidityDensity", "SweepDepth", "ReclaimQuality", "PostSweepDisplacement",
    "StructureShiftAfterSweep", "RetestQuality", "CompressionDepth", "CompressionDuration", "ExpansionVelocity",
    "TrendRangeScore", "RelativeVolume",
)
# Look-back lengths in bars.
LOOKBACKS = {"internal": 12, "external": 48, "level": 48, "volume": 48, "compression": 12}
EPSILON = 2.220446049250313e-16
SETUPS = ("breakout", "liquidity_sweep_reclaim", "compression_release")
# Setup thresholds.
THRESHOLDS = {"breakoutStrength": 0.2, "sweepStrength": 0.15, "reclaimStrength": 0.05, "compressionDepth": 0.2,
              "compressionDuration": 0.25, "expansionVelocity": 1.25}


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def _structure(s: Study, p: int) -> str:
    def edge(fn, src, a, b):
        return lambda w: fn(src).over(w.rowsBetween(a, b))

    names = [f"st{p}_{x}" for x in ("oh", "ol", "nh", "nl", "n")]
    for name, build in zip(names, (edge(F.max, "h", -2 * p, -p - 1), edge(F.min, "l", -2 * p, -p - 1),
                                   edge(F.max, "h", -p, -1), edge(F.min, "l", -p, -1),
                                   edge(F.count, "h", -2 * p, -1))):
        s.window(name, build, back=2 * p)
    oh, ol, nh, nl, n = (F.col(x) for x in names)
    score = F.when(n < 2 * p, 0.0).when((nh > oh) & (nl > ol), 1.0).when((nh < oh) & (nl < ol), -1.0).otherwise(0.0)
    s.row(f"structure_{p}", score, names)
    return f"structure_{p}"


def features(bars: DataFrame, config: dict | None = None, longest: int | None = None,
             block_rows: int = L.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Bars with the eighteen features; only earlier bars are read."""
    cfg = {**LOOKBACKS, **(config or {})}
    if any(not isinstance(v, int) or v < 2 for v in cfg.values()):
        raise ValueError("look-backs must be integers of at least 2")
    s = Study.for_bars(bars, L.longest_series(bars) if longest is None else longest, block_rows)
    o, h, l, c, v = (F.col(x) for x in ("o", "h", "l", "c", "v"))
    s.row("rng", F.greatest(F.lit(0.0), h - l))
    lev, ext, com, vol = cfg["level"], cfg["external"], cfg["compression"], cfg["volume"]
    s.window("lev_h", lambda w: F.max("h").over(w.rowsBetween(-lev, -1)), back=lev)
    s.window("lev_l", lambda w: F.min("l").over(w.rowsBetween(-lev, -1)), back=lev)
    s.window("lev_hs", lambda w: F.collect_list("h").over(w.rowsBetween(-lev, -1)), back=lev)
    s.window("lev_ls", lambda w: F.collect_list("l").over(w.rowsBetween(-lev, -1)), back=lev)
    s.window("long_avg", lambda w: F.avg("rng").over(w.rowsBetween(-ext, -1)), ["rng"], back=ext)
    s.window("short_rs", lambda w: F.collect_list("rng").over(w.rowsBetween(-com, -1)), ["rng"], back=com)
    s.window("vol_mid", lambda w: F.percentile("v", 0.5).over(w.rowsBetween(-vol, -1)), back=vol)
    internal, external = _structure(s, cfg["internal"]), _structure(s, cfg["external"])
    s.lag("c")

    rng = F.col("rng")
    avg_long = F.coalesce(F.nullif(F.col("long_avg"), F.lit(0.0)), F.nullif(rng, F.lit(0.0)), F.lit(1.0))
    n_short = F.size("short_rs")
    short_mean = F.when(n_short > 0, F.aggregate("short_rs", F.lit(0.0), lambda a, x: a + x) / n_short)
    s.row("al", avg_long, ["long_avg", "rng"])
    al = F.col("al")
    s.row("as_", F.coalesce(F.nullif(short_mean, F.lit(0.0)), al), ["short_rs", "al"])
    has = F.col("lev_h").isNotNull()
    ph, pl = F.coalesce("lev_h", "h"), F.coalesce("lev_l", "l")
    up, dn = has & (c > ph), has & (c < pl)
    levels = ["lev_h", "lev_l", "lev_hs", "lev_ls", "al", "as_"]
    side = F.when(up, 1.0).when(dn, -1.0).otherwise(0.0)
    s.row("brk_side", side, levels)
    s.row("brk_level", F.when(up, ph).when(dn, pl), levels)
    gap = F.when(up, c - ph).when(dn, c - pl).otherwise(0.0)
    disp = F.col("brk_side") * clamp(F.abs(gap) / al, 0, 3)
    s.row("BreakoutDisplacement", disp, ["brk_side"])
    s.row("BOSStrength", F.col("BreakoutDisplacement"), ["BreakoutDisplacement"])
    s.row("InternalStructure", F.col(internal), [internal])
    s.row("ExternalStructure", F.col(external), [external])
    es = F.col("ExternalStructure")
    s.row("CHOCHStrength", F.when((F.col("brk_side") != 0) & (es != 0) & (F.col("brk_side") != es),
                                  F.col("BreakoutDisplacement")).otherwise(0.0),
          ["ExternalStructure", "BreakoutDisplacement"])
    hs, ls = has & (h > ph) & (c < ph), has & (l < pl) & (c > pl)
    s.row("SweepDepth", F.when(hs, -clamp((h - ph) / al, 0, 3)).when(ls, clamp((pl - l) / al, 0, 3)).otherwise(0.0), levels)
    s.row("ReclaimQuality", F.when(hs, -clamp((ph - c) / al, 0, 2)).when(ls, clamp((c - pl) / al, 0, 2)).otherwise(0.0), levels)
    span = F.greatest(ph - pl, F.lit(EPSILON))
    s.row("RangeBoundary", F.when(has, clamp((c - (ph + pl) / 2) / (span / 2), -1, 1)).otherwise(0.0), levels)
    tol = al * 0.25
    near = [F.size(F.filter(x, lambda y: F.abs(y - c) <= tol)) for x in ("lev_hs", "lev_ls")]
    s.row("LiquidityDensity", F.when(has, (near[0] + near[1]) / (F.size("lev_hs") * 2)).otherwise(0.0), levels)
    wick = F.greatest(h - F.greatest(o, c), F.least(o, c) - l)
    close_by = F.when(has, 1 - clamp(F.least(F.abs(h - ph), F.abs(l - pl)) / al, 0, 1)).otherwise(0.0)
    wick_part = F.when(rng > 0, wick / rng).otherwise(0.0)
    s.row("SwingQuality", clamp(wick_part * close_by, 0, 1), levels)
    prev_sweep = s.lag("SweepDepth")
    swept = F.coalesce(prev_sweep != 0, F.lit(False))
    s.row("PostSweepDisplacement", F.when(swept, clamp((c - F.col("c_lag1")) / al, -3, 3)).otherwise(0.0),
          ["SweepDepth_lag1"])
    pi, ci = s.lag("InternalStructure"), F.col("InternalStructure")
    s.row("StructureShiftAfterSweep", F.when(swept & (ci != 0) & (ci != pi), ci).otherwise(0.0),
          ["InternalStructure_lag1", "SweepDepth_lag1"])
    pd, lv = s.lag("brk_side"), s.lag("brk_level")
    held = (l <= lv) & (h >= lv) & F.when(pd > 0, c >= lv).otherwise(c <= lv)
    s.row("RetestQuality", F.when((pd != 0) & held, pd * clamp(1 - F.abs(c - lv) / al, 0, 1)).otherwise(0.0),
          ["brk_side_lag1", "brk_level_lag1"])
    ratio = F.col("as_") / al
    s.row("CompressionDepth", clamp(1 - ratio, 0, 1), ["as_"])
    # Trailing run of short ranges: cut at the last one that is not short.
    wide = F.array_position(F.reverse(F.transform("short_rs", lambda x: x >= al * 0.75)), True)
    run = F.when(wide > 0, wide - 1).otherwise(n_short)
    s.row("CompressionDuration", F.when(n_short > 0, run / com).otherwise(0.0), ["short_rs", "al"])
    body_part = F.when(rng > 0, F.abs(c - o) / rng).otherwise(0.0)
    s.row("ExpansionVelocity", clamp(rng / al * body_part, 0, 4), ["al"])
    s.row("TrendRangeScore", clamp((ci + es) / 2, -1, 1), ["InternalStructure", "ExternalStructure"])
    s.row("RelativeVolume", F.when(F.col("vol_mid") > 0, v / F.col("vol_mid")).otherwise(1.0), ["vol_mid"])
    df = s.frame()
    keep = [k for k in ("symbol", "timeframe", "part", L.BLOCK, L.INDEX) if k in df.columns]
    return df.select(*keep, "t", "o", "h", "l", "c", "v", *[F.col(x).cast("double").alias(x) for x in FEATURES])


def feature_signature(rows: DataFrame) -> DataFrame:
    """Order-free digest of each series' feature rows, to six places: a sum over 32 bits of each row's MD5."""
    six = lambda x: F.format_string("%.6f", F.round(F.col(x).cast("double"), 6) + F.lit(0.0))
    text = F.concat_ws("|", F.col("t").cast("string"), *[F.when(F.col(x).isNotNull(), six(x)) for x in FEATURES])
    return rows.groupBy("symbol", "timeframe").agg(
        F.count("*").alias("rows"),
        F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")).alias("signature"))


def concept_coverage(rows: DataFrame) -> DataFrame:
    """For each trading concept: rows where every feature it reads is defined, and where one is not zero.

    Only the feature columns are read, once; the concepts are a fixed list.
    """
    cells = []
    for concept, disposition, names in CONCEPTS:
        known = [F.col(x).isNotNull() for x in names] or [F.lit(False)]
        active = [F.coalesce(F.col(x) != 0, F.lit(False)) for x in names] or [F.lit(False)]
        cells.append(F.struct(F.lit(concept).alias("concept"), F.lit(disposition).alias("disposition"), F.lit(len(names)).alias("features"),
                              reduce(and_, known).alias("known"), reduce(or_, active).alias("active")))
    each = rows.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return each.groupBy("concept", "disposition", "features").agg(F.count_if("known").alias("defined_rows"), F.count_if("active").alias("active_rows"))


def with_previous(rows: DataFrame) -> DataFrame:
    """Compression of the previous bar, which the release setup needs."""
    w = L.series_window(rows)
    if L.BLOCK not in rows.columns:
        return rows.withColumns({"p_depth": F.lag("CompressionDepth").over(w),
                                 "p_dur": F.lag("CompressionDuration").over(w)})
    by = [k for k in L.series_keys(rows) if k != L.BLOCK]
    return L.neighbour(rows, by, "t", {"p_depth": "CompressionDepth", "p_dur": "CompressionDuration"}, L.BLOCK)


def _sign(x: Column) -> Column:
    return F.when(x >= 0, 1).otherwise(-1)


def candidates(rows: DataFrame) -> DataFrame:
    """Every bar that could be an event at some threshold, with what is compared.

    ``a, b, d`` are the compared values: (BOS), (sweep, reclaim) or
    (depth, duration, expansion).
    """
    prev = rows if "p_depth" in rows.columns else with_previous(rows)
    bos, sw, rc, ex = (F.col(x) for x in ("BOSStrength", "SweepDepth", "ReclaimQuality", "ExpansionVelocity"))
    body = F.col("c") - F.col("o")
    none = F.lit(None).cast("double")

    def event(kind, on, side, strength, a, b=none, d=none):
        return F.when(on, F.struct(F.lit(kind).alias("kind"), side.alias("direction"), strength.alias("strength"),
                                   a.alias("a"), b.alias("b"), d.alias("d")))

    events = F.array_compact(F.array(
        event("breakout", bos != 0, _sign(bos), F.abs(bos), F.abs(bos)),
        event("liquidity_sweep_reclaim", sw != 0, _sign(sw), F.least(F.lit(3.0), F.abs(sw) + F.abs(rc)),
              F.abs(sw), F.abs(rc)),
        event("compression_release", (body != 0) & F.col("p_depth").isNotNull(), _sign(body),
              ex * (1 + F.col("p_depth")), F.col("p_depth"), F.col("p_dur"), ex)))
    return prev.withColumn("_e", F.explode(events)).select("*", "_e.*").drop("_e")


def _fires(cfg) -> Column:
    get = cfg if callable(cfg) else (lambda k: F.lit(cfg[k]))
    a, b, d, kind = F.col("a"), F.col("b"), F.col("d"), F.col("kind")
    return (
        F.when(kind == "breakout", a >= get("breakoutStrength"))
        .when(kind == "liquidity_sweep_reclaim", (a >= get("sweepStrength")) & (b >= get("reclaimStrength")))
        .otherwise((a >= get("compressionDepth")) & (b >= get("compressionDuration")) & (d >= get("expansionVelocity"))))


def detect_setups(rows: DataFrame, config: dict | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Setup events, up to three per bar.

    ``thresholds`` holds the six numbers of each series as columns named as in
    ``THRESHOLDS``; a series without a row, or a null, takes the fixed number.
    ``config`` stands above both.
    """
    found = candidates(rows)
    if thresholds is None:
        return found.where(_fires({**THRESHOLDS, **(config or {})}))
    own = thresholds.select(*L.SERIES, *[F.col(k).alias(f"th_{k}") for k in THRESHOLDS])
    number = lambda k: F.lit(config[k]) if k in (config or {}) else F.coalesce(F.col(f"th_{k}"), F.lit(THRESHOLDS[k]))
    return found.join(own, list(L.SERIES), "left").where(_fires(number)).drop(*[f"th_{k}" for k in THRESHOLDS])


# Outside concepts, whether they are used, and the features that stand for them.
CONCEPTS = [
    ("Squeeze Momentum Indicator Version2", "MAPPED", ["CompressionDepth", "CompressionDuration", "ExpansionVelocity"]),
    ("HIGH and LOW Optimized Trend Tracker (HOTT/LOTT)", "MAPPED", ["RangeBoundary", "BreakoutDisplacement", "BOSStrength"]),
    ("AlphaTrend", "MAPPED", ["TrendRangeScore", "RangeBoundary", "RetestQuality"]),
    ("Optimized Trend Tracker (OTT)", "REFERENCE_ONLY", ["TrendRangeScore"]),
    ("Follow Line", "REFERENCE_ONLY", []),
    ("ST0P", "REFERENCE_ONLY", []),
    ("TKE Indicator", "EXCLUDED", []),
    ("MACD ReLoaded", "EXCLUDED", []),
    ("MavilimW", "EXCLUDED", []),
]


def candidate_catalogue(spark: SparkSession) -> DataFrame:
    """Which features each trading concept reads."""
    return spark.createDataFrame(CONCEPTS, "concept string, disposition string, features array<string>")


# --- event study -----------------------------------------------------------------


def with_paths(rows: DataFrame, horizons: list[int], block_rows: int | None = None) -> DataFrame:
    """Close ``h`` bars later and the path's extremes, for each horizon.

    Rows that are cut into blocks (of any size) are read over the blocks' edges:
    their row index says where a block of ``block_rows`` begins.
    """
    if block_rows is None and L.BLOCK in rows.columns:
        block_rows = L.DEFAULT_BLOCK_ROWS
    wide = L.with_halo(L.into_blocks(rows, block_rows), block_rows, 0, max(horizons)) if block_rows else rows
    w = L.series_window(wide)
    cols = {}
    for k in horizons:
        f = w.rowsBetween(1, k)
        cols |= {f"x{k}": F.lead("c", k).over(w), f"hi{k}": F.max("h").over(f), f"lo{k}": F.min("l").over(f)}
    out = wide.withColumns(cols)
    return out.where("_core").drop("_core") if block_rows else out


def outcomes(events: DataFrame, horizons: list[int], costs: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per event, horizon and cost scenario.

    ``events`` carries the paths, the row index ``i`` and the end ``wf_end`` of
    its window; an event whose exit falls behind that end is dropped.
    """
    grid = F.explode(F.array(*[
        F.struct(F.lit(k).alias("horizon"), F.lit(name).alias("cost_name"), F.lit(2 * (fee + slip)).alias("cost"),
                 F.col(f"x{k}").alias("x"), F.col(f"hi{k}").alias("hi"), F.col(f"lo{k}").alias("lo"))
        for k in horizons for name, (fee, slip) in costs.items()]))
    rows = events.withColumn("_g", grid).select("*", "_g.*").drop("_g")
    rows = rows.where((F.col("i") + F.col("horizon") < F.col("wf_end")) & F.col("x").isNotNull() & (F.col("c") > 0))
    d, e = F.col("direction"), F.col("c")
    at = lambda p: d * (p - e) / e
    return rows.withColumns({"gross": at(F.col("x")), "mae": F.least(at(F.col("hi")), at(F.col("lo"))),
                             "mfe": F.greatest(at(F.col("hi")), at(F.col("lo")))}).withColumn(
        "net", F.col("gross") - F.col("cost"))


def summarize(outcome: DataFrame, by: list[str], every: DataFrame | None = None) -> DataFrame:
    """Hit rate and expectancies per group; ``every`` lists groups that must appear."""
    net = F.col("net")
    stats = outcome.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(net > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg("gross").alias("gross_exp"), F.avg("net").alias("net_exp"),
        F.avg(F.when(net > 0, net)).alias("avg_win"), F.avg(F.when(net <= 0, net)).alias("avg_loss"),
        F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"))
    if every is not None:
        stats = every.join(stats, by, "left")
    stats = stats.na.fill(0)
    return stats.withColumn("break_even_cost", F.greatest(F.lit(0.0), F.col("gross_exp")))
