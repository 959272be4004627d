import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.plans import monitor as M
from barlight.sources import files as S
from barlight.streaming import pipeline as P
from barlight.streaming.catalogue import CatalogueStream
from barlight.strategies.registry import signals

BAR = "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_strict_csv(spark, tmp_path):
    p = write(tmp_path / "AAA-1m.csv", "Volume,CLOSE,low,High,open,timestamp\n5,2,1,3,1.5,60000\n")
    r = S.read_bars_csv(spark, p, "1m").first()
    assert (r.symbol, r.t, r.o, r.h, r.l, r.c, r.v, r.closed) == ("AAA", 60000, 1.5, 3.0, 1.0, 2.0, 5.0, True)
    bad = write(tmp_path / "BBB.csv", "timestamp,open,high,low,close,volume\n60000,1,x,1,1,1\n")
    with pytest.raises(Exception, match="non-finite high"):
        S.read_bars_csv(spark, bad, "1m").collect()
    with pytest.raises(ValueError, match="missing columns"):
        S.read_bars_csv(spark, write(tmp_path / "CCC.csv", "timestamp,open\n1,2\n"), "1m")


def test_lenient_csv_drops_bad_rows(spark, tmp_path):
    p = write(tmp_path / "AAA.csv", "t,o,h,l,c,v\n1,1,2,1,1,9\n2,1,nan,1,1,9\n3,1,2,1,,9\n4,1,2,1,1,9\n")
    assert [r.t for r in S.read_bars_csv_lenient(spark, p, "1m").orderBy("t").collect()] == [1, 4]


@pytest.mark.parametrize("unit,raw", [("s", 1_704_067_200), ("ms", 1_704_067_200_000), ("us", 1_704_067_200_000_000), ("ns", 1_704_067_200_000_000_000)])
def test_columnar_units(spark, tmp_path, unit, raw):
    pd.DataFrame({"date": [raw], "open": [1], "high": [2], "low": [1], "close": [2], "volume": [3]}).to_parquet(tmp_path / "AAA-x.parquet")
    r = S.read_bars_columnar(spark, str(tmp_path / "AAA-x.parquet"), "1m").first()
    assert (r.symbol, r.t, r.v) == ("AAA", 1_704_067_200_000, 3.0)


def test_the_last_nanosecond_stays_in_its_millisecond(spark):
    first, last = 1_704_067_200_000_000_000, 1_704_067_200_000_999_999
    raw = spark.createDataFrame([(s, k // n, 1.0, 1.0, 1.0, 1.0, 1.0) for s, n in (("ns", 1), ("us", 1000)) for k in (first, last)],
                                "symbol string, time bigint, o double, h double, l double, c double, v double")
    assert [r.t for r in S.normalize_columns(raw, "1m").collect()] == [1_704_067_200_000] * 4


def test_feather_and_archives(spark, tmp_path):
    pd.DataFrame({"date": pd.to_datetime([1_704_067_200_000, 1_704_067_260_000], unit="ms", utc=True), "open": [1.0, 2.0], "high": [2.0, 3.0], "low": [1.0, 1.0],
                  "close": [2.0, 2.0], "volume": [3.0, 4.0]}).to_feather(tmp_path / "AAA_x.feather")
    got = S.read_bars_feather(spark, str(tmp_path / "AAA_x.feather"), "1m").orderBy("t").collect()
    assert [(r.symbol, r.t, r.c) for r in got] == [("AAA", 1_704_067_200_000, 2.0), ("AAA", 1_704_067_260_000, 2.0)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x.csv", "open_time,open,high,low,close,volume,a,b,c,d,e,f\n1704067200000,1,2,1,2,3,0,0,0,0,0,0\n1704067260000,1,2,1,2,,0,0,0,0,0,0\n")
    (tmp_path / "BBB-1m-2024.zip").write_bytes(buf.getvalue())
    got = S.read_kline_archives(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.t, r.v) for r in got] == [("BBB", 1_704_067_200_000, 3.0)]


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1h", "s", 1.0, True, [1.0]), ("B", "1h", "s", 2.0, True, [1.0]), ("C", "4h", "s", 3.0, False, [1.0])],
                                 "symbol string, timeframe string, strategy_id string, net double, pass boolean, seg array<double>")
    out = str(tmp_path / "out")
    S.write_results(rows, out, failures=rows.where("NOT pass"), top=1)
    assert spark.read.parquet(f"{out}/results").count() == 3
    assert spark.read.option("header", True).csv(f"{out}/top").first().symbol == "B"
    S.write_board(rows, f"{out}/board")
    again = S.read_results(spark, f"{out}/board", "symbol string, timeframe string, strategy_id string, net double, pass boolean")
    assert again.count() == 3
    assert "| B | 2.0000 |" in S.markdown_table(rows, ["symbol", "net"], [F.desc("net")])
    with pytest.raises(ValueError):
        S.universe(rows, least=5, timeframe="1h")


def stream(spark, path, rows, schema, per_file):
    """One file per micro-batch, oldest first."""
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k:k + per_file], schema).coalesce(1).write.mode("append").json(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def drain(df, name, tmp_path):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_stream_bars_equal_batch(spark, rows, tmp_path):
    from barlight.operators.bars import resample

    one = [r for r in rows if r[0] == "AAAUSDT"][:120]
    got = drain(P.stream_bars(stream(spark, tmp_path / "in", one, BAR, 40), 3_600_000, "0 seconds", "1h"), "hourly", tmp_path)
    want = resample(spark.createDataFrame(one, BAR), "1h")
    # The newest bucket is still open.
    assert got.count() >= want.count() - 2
    assert got.exceptAll(want.select(got.columns)).isEmpty()
    late = P.late_rows(spark.createDataFrame(one, BAR), one[8][2], 3_600_000)
    assert late.count() == 8 and late.first().freshness == "MISSED"


def test_strategy_stream_equals_batch_and_blocks_on_gaps(spark, rows, bars, tmp_path):
    one = [r for r in rows if r[0] == "AAAUSDT"]
    again = one[:200] + one[195:]  # Repeated bars are ignored.
    s = P.strategy_stream(stream(spark, tmp_path / "in", again, BAR, 150), "sr25_donchian_breakout", P.ChannelBreak, 900_000)
    got = drain(s, "steps", tmp_path)
    from barlight.plans.decisions import transitions

    want = transitions(signals(bars.where("symbol = 'AAAUSDT'"), ["sr25_donchian_breakout"], 10)).select("candle_close_t", "state_before", "state_after")
    ev = got.where("kind = 'EVENT'").select("candle_close_t", "state_before", "state_after")
    assert want.count() > 5 and ev.exceptAll(want).isEmpty() and want.exceptAll(ev).isEmpty()
    assert {r.kind for r in got.select("kind").distinct().collect()} <= {"EVENT", "OUT_OF_ORDER_CANDLE"}
    gap = [r for r in rows if r[0] == "BBBUSDT"][:260]
    found = drain(P.strategy_stream(stream(spark, tmp_path / "gap", gap, BAR, 130), "x", P.SweepReclaim, 900_000), "gaps", tmp_path)
    assert found.where("kind = 'GAP'").count() == 260 - 201


def test_journal_stream_equals_batch(spark, tmp_path):
    log = [("U%d" % (i % 3), i * 1000, [1, 1, -1, 0, -1][i * 7 % 5], 100.0 + i * 13 % 17, "c") for i in range(60)]
    schema = "underlying string, t bigint, side int, price double, cohort string"
    got = drain(P.journal_stream(stream(spark, tmp_path / "in", log, schema, 15)), "journal", tmp_path).where("kind = 'CLOSE'")
    batch = M.paper_journal(spark.createDataFrame(log, schema)).where("NOT is_open")
    cols = ["underlying", "side", "entry_t", "exit_t", "reason"]
    assert batch.count() > 10
    assert got.select(cols).exceptAll(batch.select(cols)).isEmpty() and batch.select(cols).exceptAll(got.select(cols)).isEmpty()
    a = {(r.underlying, r.entry_t): r.net for r in got.collect()}
    assert all(abs(a[(r.underlying, r.entry_t)] - r.net) < 1e-9 for r in batch.collect())


def test_duplicate_events_and_arming(spark, tmp_path):
    ev = [("e%d" % (i % 5), 1_704_067_200_000 + i, i) for i in range(20)]
    s = stream(spark, tmp_path / "in", ev, "event_id string, ts_ms bigint, candle_close_t bigint", 10).withColumn("ts", F.timestamp_millis("ts_ms"))
    got = drain(P.unique_events(P.after_arming(s, 3), "ts", "1 hour"), "unique", tmp_path)
    assert sorted(r.event_id for r in got.collect()) == ["e0", "e1", "e2", "e3", "e4"]


def test_batches_are_written_once(spark, tmp_path):
    run = P.decide_and_append(spark.range(1), str(tmp_path / "d"), lambda b, s: b)
    for batch_id in (0, 1, 1):
        run(spark.range(3), batch_id)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 6


BOUNDED = ["mavilimw", "sr25_donchian_breakout", "vis_hull_suite", "vis_fractal_breakout", "vis_coppock", "vis_bb_mean_reversion", "vis_sr_breaks", "vis_high_volume_box",
           "vis_fibonacci_bb", "vis_candlestick_reversal", "vis_tma_overlay", "vis_nadaraya_watson"]


def test_catalogue_stream_equals_batch(spark, rows, tmp_path):
    """Twelve strategies over micro-batches, begun in the middle, with repeated and late bars, and a batch that runs twice."""
    known = [r for r in rows if r[0] == "AAAUSDT"][:260]
    new = [r for r in rows if r[0] == "AAAUSDT"][260:] + [r for r in rows if r[0] == "BBBUSDT"]
    new = sorted(new, key=lambda r: r[2])
    new = new[:300] + new[280:]
    s = CatalogueStream(spark, BOUNDED, str(tmp_path / "state"), spark.createDataFrame(known, BAR))
    q = s.start(stream(spark, tmp_path / "in", new, BAR, 330), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = s.signals(spark).select("symbol", "strategy_id", "t", "sig").cache()
    every = spark.createDataFrame(known + new, BAR).dropDuplicates(["symbol", "t"])
    want = signals(every, BOUNDED, 10).where(f"symbol = 'BBBUSDT' OR t > {known[-1][2]}").select(got.columns).cache()
    assert want.select("strategy_id").distinct().count() >= 10 and got.select("strategy_id").distinct().count() >= 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    s.run(spark.createDataFrame(new[:330], BAR), 0)
    assert s.signals(spark).count() == got.count()
    held = spark.read.parquet(str(tmp_path / "state" / "last" / "batch=1"))
    assert held.groupBy("symbol").count().agg(F.max("count")).first()[0] <= s.keep
    with pytest.raises(ValueError, match="pmax"):
        CatalogueStream(spark, ["pmax"], str(tmp_path / "other"))
