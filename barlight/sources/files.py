"""Reading bars, archives and results; writing results and boards."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.operators.bars import epoch_ms

CSV_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
SHORT = ("t", "o", "h", "l", "c", "v")
TIME_ALIASES = ("date", "timestamp", "time", "t")
BAR_SCHEMA = "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double"


def _symbol_from_path() -> Column:
    """Text before the first '-' or '_' of the file name."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^([^-_.]+)", 1)


def read_bars_csv(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Strict reader: six named columns in any case and order; a bad cell fails the job.

    All files of one read share a header, checked on the first one; Spark reads
    the rest against that schema and fails on a different header.
    """
    header = spark.read.option("header", True).csv(path).limit(0).columns
    found = {h.strip().lower(): h for h in header}
    missing = [c for c in CSV_COLUMNS if c not in found]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)

    def number(name: str) -> Column:
        x = F.col(f"`{found[name]}`").try_cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(ok, x).otherwise(F.raise_error(F.concat(F.lit(f"non-finite {name}: "), F.coalesce(F.col(f"`{found[name]}`"), F.lit("empty")))).cast("double"))

    cols = [number(c).alias(s) for c, s in zip(CSV_COLUMNS, SHORT)]
    return raw.select(_symbol_from_path().alias("symbol"), F.lit(timeframe).alias("timeframe"), *cols).withColumn(
        "t", F.col("t").cast("long")).withColumn("closed", F.lit(True))


def read_bars_csv_lenient(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Six positional columns; rows with any undefined or non-finite cell are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in SHORT])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    cells = raw.select(_symbol_from_path().alias("symbol"), F.lit(timeframe).alias("timeframe"),
                       *[F.col(c).try_cast("double").alias(c) for c in SHORT])
    ok = F.lit(True)
    for c in SHORT:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return cells.where(ok).withColumn("t", F.col("t").cast("long"))


def normalize_columns(raw: DataFrame, timeframe: str, symbol: Column | None = None) -> DataFrame:
    """Bars from a columnar table whose time column has one of several names and units."""
    names = {c.lower(): c for c in raw.columns}
    time = next((names[a] for a in TIME_ALIASES if a in names), None)
    if time is None:
        raise ValueError(f"no time column among {TIME_ALIASES}")
    long_names = dict(zip(SHORT[1:], CSV_COLUMNS[1:]))
    cols = {s: names.get(n) or names.get(s) for s, n in long_names.items()}
    if None in cols.values():
        raise ValueError("open, high, low, close and volume are required")
    who = symbol if symbol is not None else F.col(names["symbol"])
    kind = raw.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        stamp = F.unix_millis(F.col(time).cast("timestamp"))
        rows = raw.select(who.alias("symbol"), stamp.alias("t"), *[F.col(c).cast("double").alias(s) for s, c in cols.items()])
    else:
        rows = raw.select(who.alias("symbol"), F.col(time).cast("long").alias("t"), *[F.col(c).cast("double").alias(s) for s, c in cols.items()])
        # One row per symbol decides the unit, by its smallest time.
        unit = rows.groupBy("symbol").agg(F.min("t").alias("_first"))
        rows = rows.join(unit, "symbol").withColumn("t", epoch_ms(F.col("t"), F.col("_first"))).drop("_first")
    return rows.select("symbol", F.lit(timeframe).alias("timeframe"), "t", "o", "h", "l", "c", "v")


def read_bars_columnar(spark: SparkSession, path: str, timeframe: str, fmt: str = "parquet") -> DataFrame:
    """Parquet or ORC bars with alias-tolerant columns."""
    raw = spark.read.format(fmt).load(path)
    symbol = None if "symbol" in {c.lower() for c in raw.columns} else _symbol_from_path()
    return normalize_columns(raw, timeframe, symbol)


def read_bars_feather(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """Feather files, one symbol each: a task reads a file and hands on its record batches."""
    def parse(batches):
        import pyarrow as pa
        import pyarrow.feather as feather

        for batch in batches:
            for k in range(batch.num_rows):  # one file's bytes at a time
                row = batch.slice(k, 1).to_pylist()[0]
                table = feather.read_table(io.BytesIO(row["content"]))
                names = {c.lower(): c for c in table.column_names}
                time = table[next(names[a] for a in TIME_ALIASES if a in names)]
                if pa.types.is_timestamp(time.type):
                    time = time.cast(pa.timestamp("ms", tz=time.type.tz))
                data = [pa.array([row["symbol"]] * table.num_rows), time.cast(pa.int64()).combine_chunks()]
                for s, n in zip(SHORT[1:], CSV_COLUMNS[1:]):
                    data.append(table[names.get(n) or names[s]].cast(pa.float64()).combine_chunks())
                yield from pa.table(data, names=["symbol", *SHORT]).to_batches(max_chunksize=65_536)

    files = spark.read.format("binaryFile").load(path).select(_symbol_from_path().alias("symbol"), "content")
    raw = files.mapInArrow(parse, "symbol string, t bigint, o double, h double, l double, c double, v double")
    return normalize_columns(raw, timeframe, F.col("symbol"))


def read_kline_archives(spark: SparkSession, path: str, timeframe: str = "1m") -> DataFrame:
    """Zipped twelve-column kline files, header optional; the first six columns count."""
    def unzip(frames):
        for frame in frames:
            for symbol, content in zip(frame["symbol"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        with z.open(name) as f:
                            for part in pd.read_csv(f, header=None, usecols=range(6), names=list(SHORT), dtype=str, chunksize=50_000):
                                part = part.apply(pd.to_numeric, errors="coerce").dropna()
                                part.insert(0, "symbol", symbol)
                                yield part.astype({"t": "int64", **{c: "float64" for c in SHORT[1:]}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    raw = files.select(_symbol_from_path().alias("symbol"), "content").mapInPandas(
        unzip, "symbol string, t bigint, o double, h double, l double, c double, v double")
    return normalize_columns(raw, timeframe, F.col("symbol"))


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Result shards as JSON lines; a row delivered by two shards counts once."""
    rows = spark.read.schema(schema).json(path)
    keys = [c for c in ("symbol", "timeframe", "strategy_id", "variantId", "month") if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def universe(bars: DataFrame, least: int = 500, timeframe: str = "1m") -> DataFrame:
    """Symbols with bars of ``timeframe``; fails when fewer than ``least`` exist."""
    names = bars.where(F.col("timeframe") == timeframe).select("symbol").distinct()
    n = names.count()
    if n < least:
        raise ValueError(f"{n} symbols, expected at least {least}")
    return names


# --- sinks ---------------------------------------------------------------------


def write_results(results: DataFrame, path: str, monthly: DataFrame | None = None, failures: DataFrame | None = None,
                  top: int = 500, mode: str = "overwrite") -> None:
    """Results by timeframe, months, failures, and the best rows as one CSV."""
    results.write.mode(mode).partitionBy("timeframe").parquet(f"{path}/results")
    flat = results.drop(*[f.name for f in results.schema if isinstance(f.dataType, (T.ArrayType, T.StructType))])
    best = flat.where("pass").orderBy(F.desc("net"), "symbol", "timeframe", "strategy_id").limit(top)
    best.coalesce(1).write.mode(mode).option("header", True).csv(f"{path}/top")
    if monthly is not None:
        monthly.write.mode(mode).partitionBy("month").json(f"{path}/monthly")
    if failures is not None:
        failures.write.mode(mode).json(f"{path}/failures")


def pending_keys(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Plan rows without a stored result: what a resumed run still has to do."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def write_board(board: DataFrame, path: str, mode: str = "overwrite") -> None:
    board.write.mode(mode).json(path)


def markdown_table(board: DataFrame, columns: list[str], order: list[Column], rows: int = 100) -> str:
    """The first rows of a board as a table for people."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    for r in board.select(*columns).orderBy(*order).limit(rows).collect():
        lines.append("| " + " | ".join(f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |")
    return "\n".join(lines) + "\n"
