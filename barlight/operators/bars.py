"""Resampling, quality, coverage and calendar operators on bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.operators import layout as L
from barlight.session import DAY_MS, TIMEFRAME_MS

OHLCV = ("o", "h", "l", "c", "v")


def _fold() -> list[Column]:
    return [F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"),
            F.max_by("c", "t").alias("c"), F.sum("v").alias("v")]


def bucket(t: Column, size_ms: int) -> Column:
    return (F.floor(t / F.lit(size_ms)) * F.lit(size_ms)).cast("long")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars; an algebraic aggregate, so hot symbols combine before the shuffle."""
    out = bars.groupBy("symbol", bucket(F.col("t"), TIMEFRAME_MS[timeframe]).alias("_t")).agg(*_fold())
    return out.select("symbol", F.lit(timeframe).alias("timeframe"), F.col("_t").alias("t"), *OHLCV)


def resample_many(bars: DataFrame, timeframes: list[str]) -> DataFrame:
    """Several timeframes from one scan of the base bars."""
    sizes = F.explode(F.array(*[F.struct(F.lit(tf).alias("tf"), F.lit(TIMEFRAME_MS[tf]).alias("ms")) for tf in timeframes]))
    spread = bars.select("symbol", "t", *OHLCV, sizes.alias("_s"))
    t = (F.floor(F.col("t") / F.col("_s.ms")) * F.col("_s.ms")).cast("long")
    out = spread.groupBy("symbol", F.col("_s.tf").alias("timeframe"), t.alias("_t")).agg(*_fold())
    return out.select("symbol", "timeframe", F.col("_t").alias("t"), *OHLCV)


def resample_calendar(bars: DataFrame, unit: str) -> DataFrame:
    """UTC days, Monday weeks or months, with the bucket's end as close time."""
    name = {"day": "1d", "week": "1w", "month": "1M"}[unit]
    start = F.date_trunc(unit, F.timestamp_millis("t"))
    out = bars.groupBy("symbol", start.alias("_s")).agg(*_fold())
    closes = {"day": F.col("_s") + F.expr("INTERVAL 1 DAY"), "week": F.col("_s") + F.expr("INTERVAL 7 DAY"),
              "month": F.add_months(F.col("_s").cast("date"), 1).cast("timestamp")}[unit]
    return out.select("symbol", F.lit(name).alias("timeframe"), F.unix_millis("_s").alias("t"), *OHLCV,
                      F.unix_millis(closes).alias("close_t"))


def base_timeframe(stored: list[str], target_ms: int) -> str:
    """The coarsest stored timeframe that divides the target."""
    fits = [tf for tf in stored if target_ms % TIMEFRAME_MS[tf] == 0]
    if not fits:
        raise ValueError("no stored timeframe divides the target")
    return max(fits, key=TIMEFRAME_MS.get)


def merge_bars(current: DataFrame, increments: DataFrame, keep: str = "last",
               start: int | None = None, end: int | None = None) -> DataFrame:
    """Union of two bar tables, one row per time; the later source wins (or the first)."""
    both = current.withColumn("_rank", F.lit(0)).unionByName(increments.withColumn("_rank", F.lit(1)))
    if start is not None:
        both = both.where(F.col("t") >= start)
    if end is not None:
        both = both.where(F.col("t") < end)
    pick = F.max_by if keep == "last" else F.min_by
    cols = [c for c in current.columns if c not in ("symbol", "timeframe", "t")]
    return (both.groupBy("symbol", "timeframe", "t")
            .agg(pick(F.struct(*cols), "_rank").alias("_r")).select("symbol", "timeframe", "t", "_r.*"))


def closed_only(bars: DataFrame, as_of: int, interval_ms: int) -> DataFrame:
    return bars.where(F.col("t") + interval_ms <= as_of)


def epoch_ms(raw: Column, first: Column) -> Column:
    """Milliseconds from a time whose unit is told by the magnitude of ``first``."""
    # Whole-number division: a double holds no nanoseconds.
    per = lambda n: F.call_function("div", raw, F.lit(n))
    return F.when(first < 1e10, raw * 1000).when(first > 1e16, per(1_000_000)).when(first > 1e13, per(1000)).otherwise(raw).cast("long")


# --- quality -----------------------------------------------------------------


def bad_ohlc() -> Column:
    return ((F.col("h") < F.col("l")) | (F.col("h") < F.greatest("o", "c")) | (F.col("l") > F.least("o", "c")))


def with_previous_time(bars: DataFrame, seq: str, chunk_size: int) -> DataFrame:
    """Add ``_pt``, the time of the row before in order ``seq``.

    Raw input may repeat times, so a series has no bound here; rows meet only
    inside chunks of ``seq``, and the chunks' edges meet each other.
    """
    chunked = bars.withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk_size)))
    return L.neighbour(chunked, ["symbol", "timeframe"], seq, {"_pt": "t"}, "_chunk").drop("_chunk")


def quality_report(bars: DataFrame, seq: str = "seq", tolerance: float = 1.5, chunk_size: int = 1_000_000) -> DataFrame:
    """Per series: order, gap and sanity counts in arrival order ``seq``."""
    if tolerance <= 1:
        raise ValueError("tolerance must be above 1")
    by = ("symbol", "timeframe")
    rows = with_previous_time(bars, seq, chunk_size).withColumn("delta", F.col("t") - F.col("_pt"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("candles"),
        F.min_by("t", seq).alias("first_t"), F.max_by("t", seq).alias("last_t"),
        F.count_if(F.col("delta") == 0).alias("duplicates"),
        F.count_if(F.col("delta") <= 0).alias("non_increasing"),
        F.count_if(bad_ohlc()).alias("invalid_ohlc"),
        F.count_if(F.col("v") < 0).alias("negative_volume"),
    )
    # Distinct steps are few next to rows; mode and gaps come from their counts.
    steps = rows.where(F.col("delta") > 0).groupBy(*by, "delta").agg(F.count("*").alias("n"))
    mode = steps.groupBy(*by).agg(F.max_by("delta", F.struct(F.col("n"), -F.col("delta"))).alias("interval"))
    ratio = F.col("delta") / F.col("interval")
    gaps = steps.join(mode, list(by)).groupBy(*by).agg(
        F.max("interval").alias("interval"),
        F.sum(F.when(ratio > tolerance, F.col("n")).otherwise(0)).alias("gaps"),
        F.greatest(F.lit(1.0), F.max(ratio)).alias("largest_gap"),
    )
    out = base.join(gaps, list(by), "left").na.fill({"interval": 0, "gaps": 0, "largest_gap": 1.0})
    ok = sum((F.col(c) for c in ("duplicates", "non_increasing", "invalid_ohlc", "negative_volume", "gaps")), F.lit(0))
    return out.withColumn("pass", ok == 0)


def validate_bars(bars: DataFrame, seq: str = "t", chunk_size: int = 30 * DAY_MS) -> tuple[DataFrame, DataFrame]:
    """Split into bars fit for features and rejects with the first reason."""
    finite = F.lit(True)
    for c in ("t", *OHLCV):
        x = F.col(c).cast("double")
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    closed = F.coalesce(F.col("closed"), F.lit(False)) if "closed" in bars.columns else F.lit(True)
    rows = with_previous_time(bars, seq, chunk_size)
    reason = (
        F.when(~closed, "NOT_CLOSED").when(~finite, "NON_FINITE").when(F.col("v") < 0, "NEGATIVE_VOLUME")
        .when(bad_ohlc(), "INVALID_OHLC").when(F.col("t") <= F.col("_pt"), "NOT_INCREASING")
    )
    tagged = rows.withColumn("reason", reason).drop("_pt")
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def candle_barrier(bars: DataFrame, as_of: int, interval_ms: int, grace_ms: int = 3000,
                   min_bars: int = 64, seq: str = "t", chunk_size: int = 30 * DAY_MS) -> DataFrame:
    """One verdict per series about its freshness and regularity."""
    rows = with_previous_time(bars, seq, chunk_size).withColumn("_d", F.col("t") - F.col("_pt"))
    expected = (as_of - grace_ms) // interval_ms * interval_ms - interval_ms
    bad = F.when(F.col("t") % interval_ms != 0, "MISALIGNED_BAR").when(F.col("t") + interval_ms > as_of, "OPEN_BAR")
    flags = rows.groupBy("symbol", "timeframe").agg(
        F.count("*").alias("bars"), F.max_by("t", seq).alias("last_t"),
        F.min_by(bad, F.when(bad.isNotNull(), F.col(seq))).alias("first_bad"),
        F.coalesce(F.max(F.col("_d") <= 0), F.lit(False)).alias("back"),
        F.coalesce(F.max(F.col("_d") != interval_ms), F.lit(False)).alias("hole"),
    )
    verdict = (
        F.when(F.col("bars") < min_bars, "TOO_FEW_BARS").when(F.col("first_bad").isNotNull(), F.col("first_bad"))
        .when(F.col("back"), "OUT_OF_ORDER").when(F.col("hole"), "MISSING_BAR")
        .when(F.col("last_t") != expected, "STALE_DATA").otherwise("OK")
    )
    return flags.select("symbol", "timeframe", "bars", "last_t", F.lit(expected).cast("long").alias("expected_t"),
                        verdict.alias("verdict"))


# --- coverage and calendar -----------------------------------------------------


def coverage(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Lifetime-aware coverage of each series inside [start, end)."""
    sizes = F.create_map(*[F.lit(x) for kv in TIMEFRAME_MS.items() for x in kv])
    inside = bars.where((F.col("t") >= start) & (F.col("t") < end))
    stats = inside.groupBy("symbol", "timeframe").agg(
        F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    tf = sizes[F.col("timeframe")]
    from_t = F.greatest(F.lit(start), F.col("first_t"))
    expected = F.greatest(F.lit(1), F.floor((F.lit(end) - from_t) / tf))
    return stats.select(
        "symbol", "timeframe", "rows", "first_t", "last_t", expected.cast("long").alias("expected"),
        F.least(F.lit(1.0), F.col("rows") / expected).alias("coverage"),
        ((F.col("last_t") - F.col("first_t") + tf) / DAY_MS).alias("history_days"))


def coverage_gate(covered: DataFrame, min_days: float = 30, min_coverage: float = 0.98) -> DataFrame:
    verdict = (F.when(F.col("history_days") < min_days, "TOO_SHORT_HISTORY")
               .when(F.col("coverage") < min_coverage, "PARTIAL_LIFETIME_COVERAGE").otherwise("OK"))
    return covered.withColumn("verdict", verdict)


def passing_series(bars: DataFrame, gated: DataFrame) -> DataFrame:
    """Bars of the series that passed; the key table holds one row per series."""
    return bars.join(gated.where(F.col("verdict") == "OK").select("symbol", "timeframe"),
                     ["symbol", "timeframe"], "left_semi")


def month_windows(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Calendar months clipped to [start, end)."""
    return _months(spark.range(1).select(F.lit(start).cast("long").alias("_a")), [], end)


def series_months(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Calendar months of each series in [start, end), the first one from the series' own first bar on.

    So a series that is listed late keeps its first month, measured by what it could have had.
    A series without a bar in the range has none. One minimum a series; months are made row by row.
    """
    inside = bars.where((F.col("t") >= start) & (F.col("t") < end))
    return _months(inside.groupBy(*L.SERIES).agg(F.min("t").alias("_a")), list(L.SERIES), end)


def _months(begun: DataFrame, keys: list[str], end: int) -> DataFrame:
    last = F.timestamp_millis(F.lit(end - 1)).cast("date")
    first = F.explode(F.sequence(F.trunc(F.timestamp_millis("_a").cast("date"), "MM"), last, F.expr("INTERVAL 1 MONTH")))
    months = begun.select(*keys, "_a", first.alias("d"))
    begin = F.unix_millis(F.col("d").cast("timestamp"))
    stop = F.unix_millis(F.add_months("d", 1).cast("timestamp"))
    return months.select(*keys, F.date_format("d", "yyyy-MM").alias("month"),
                         F.greatest(begin, F.col("_a")).alias("start"), F.least(stop, F.lit(end)).alias("end"))


def month_of(t: Column) -> Column:
    return F.date_format(F.timestamp_millis(t), "yyyy-MM")


def month_slices(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars with their month window; an equi-join on the month's name."""
    rows = bars.withColumn("month", month_of(F.col("t"))).join(windows, "month")
    return rows.where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))


def archive_gap_plan(bars: DataFrame, start: int, end: int) -> DataFrame:
    """Months to fetch before the first bar and days from the last bar on."""
    edge = bars.groupBy("symbol").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    first_month = F.trunc(F.timestamp_millis("a").cast("date"), "MM")
    start_month = F.trunc(F.timestamp_millis(F.lit(start)).cast("date"), "MM")
    months = (
        edge.where(F.col("a") > start)
        .select("symbol", F.explode(F.sequence(start_month, first_month, F.expr("INTERVAL 1 MONTH"))).alias("d"))
        .select("symbol", F.lit("month").alias("kind"), F.date_format("d", "yyyy-MM").alias("period"))
    )
    last_day, end_day = F.timestamp_millis("b").cast("date"), F.timestamp_millis(F.lit(end - 1)).cast("date")
    days = (
        edge.where((F.col("b") < end - 60_000) & (last_day <= end_day))
        .select("symbol", F.explode(F.sequence(last_day, end_day, F.expr("INTERVAL 1 DAY"))).alias("d"))
        .select("symbol", F.lit("day").alias("kind"), F.date_format("d", "yyyy-MM-dd").alias("period"))
    )
    return months.unionByName(days)


def walk_forward_labels(bars: DataFrame) -> DataFrame:
    """Row index, row count and the 60/20/20 window of each bar; 30 rows at least."""
    sizes = bars.groupBy("symbol", "timeframe").agg(F.count("*").alias("n"))
    rows = L.with_index(bars).join(sizes, ["symbol", "timeframe"])
    train = F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))
    valid = F.greatest(train + 1, F.floor(F.col("n") * 0.8))
    name = F.when(F.col("i") < train, "train").when(F.col("i") < valid, "validation").otherwise("holdout")
    return (rows.where(F.col("n") >= 30)
            .withColumns({"wf": name, "wf_end": F.when(F.col("i") < train, train).when(F.col("i") < valid, valid)
                          .otherwise(F.col("n")).cast("long")}))
