"""Any catalogue strategy of bounded reach on a stream of closed bars: new bars meet the last bars of their series."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlight.functions.study import BASE, Study
from barlight.operators import layout as L
from barlight.strategies.registry import pick, signals

SIGNALS = ("symbol", "timeframe", "strategy_id", "mode", "t", "sig")


def reach_of(spark: SparkSession, strategy_id: str) -> int | None:
    """How many bars before a bar the strategy's signal on it depends on; None if that has no bound.

    The sum of the frames on the longest path of columns. Recurrences, calendar tables
    and row numbers depend on all bars before.
    """
    (chosen,) = pick([strategy_id])
    empty = spark.createDataFrame([], "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double")
    plain, cut = Study(empty), Study(empty, block_rows=1 << 20)
    for study in (plain, cut):
        chosen.build(study)
    if L.INDEX in plain or any(d.kind in ("scan", "join") for d in cut._defs.values()):
        return None
    reach: dict[str, int] = {}
    for name, d in sorted(cut._defs.items(), key=lambda x: x[1].place):
        reach[name] = d.back + max((reach.get(x, 0) for x in d.deps), default=0)
    return max(reach.values(), default=0) + 1  # a target strategy compares with the bar before


def last_bars_of(bars: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` bars of each series."""
    w = Window.partitionBy(*L.SERIES).orderBy(F.desc("t"))
    return bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


class CatalogueStream:
    """Signals of catalogue strategies over micro-batches of closed bars, and what one batch hands to the next.

    ``folder`` holds, per batch, the signals of its bars and each series' last bars. A
    batch reads only itself and the last bars of the batch before, so its cost does not
    grow with the history; a batch that runs again after a failure replaces what it
    wrote. Bars at or before a series' last bar are late or repeated and give nothing.
    ``history`` fills the last bars before the first batch, so that a stream may begin in the middle.
    Strategies whose reach has no bound raise a ValueError that names them.
    """

    def __init__(self, spark: SparkSession, ids: Iterable[str], folder: str, history: DataFrame | None = None):
        self.ids, self.folder = list(ids), folder
        reach = {i: reach_of(spark, i) for i in self.ids}
        if unbounded := sorted(i for i, r in reach.items() if r is None):
            raise ValueError(f"these strategies depend on all bars before: {unbounded}")
        self.keep = max(reach.values())
        first = history if history is not None else spark.createDataFrame([], "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double")
        last_bars_of(first.select(*BASE), self.keep).write.mode("overwrite").parquet(self._at("last", -1))

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def run(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        last = spark.read.parquet(self._at("last", batch_id - 1))
        ends = last.groupBy(*L.SERIES).agg(F.max("t").alias("_end"))
        new = batch.select(*BASE).dropDuplicates([*L.SERIES, "t"]).join(ends, list(L.SERIES), "left")
        new = new.where(F.col("_end").isNull() | (F.col("t") > F.col("_end"))).drop("_end").persist()
        try:
            # Series without a new bar are left as they are.
            moved = last.join(new.select(*L.SERIES).distinct(), list(L.SERIES), "left_semi").unionByName(new)
            made = signals(moved, self.ids).join(ends, list(L.SERIES), "left").where(F.col("_end").isNull() | (F.col("t") > F.col("_end")))
            made.select(*SIGNALS).write.mode("overwrite").parquet(self._at("signals", batch_id))
            last_bars_of(last.unionByName(new), self.keep).write.mode("overwrite").parquet(self._at("last", batch_id))
        finally:
            new.unpersist()

    def start(self, bars: DataFrame, checkpoint: str, configure: Callable = lambda w: w):
        """Begin the query over a stream of bars; ``configure`` may set a trigger."""
        return configure(bars.writeStream.foreachBatch(self.run).option("checkpointLocation", checkpoint)).start()

    def signals(self, spark: SparkSession) -> DataFrame:
        """All signals so far, with their batch."""
        return spark.read.parquet(f"{self.folder}/signals")
