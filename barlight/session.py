"""Session settings shared by tests, bench and the entry module."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# One day in milliseconds.
DAY_MS = 86_400_000

# Supported timeframes and their length in milliseconds.
TIMEFRAME_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "3h": 10_800_000,
    "4h": 14_400_000,
    "1d": 86_400_000,
}


def local_session(cores: str = "8", partitions: int = 8, app: str = "barlight") -> SparkSession:
    """A local session for tests and bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local master (tests) gets one of its own; a cluster must name one,
    as a machine-local folder would hide files from the other machines.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def reliable_checkpoint(df):
    """Cut the lineage of ``df`` in the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df):
    """``df`` as a table in the checkpoint folder, for what rounds pass on to the next round.

    A checkpoint keeps the planner's guess of its size. Guesses multiply in joins, so after some
    rounds of joins they are numbers of millions of digits and planning takes minutes; a table has its real size.
    """
    at = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def prepare(spark: SparkSession) -> SparkSession:
    """Settle what results depend on: UTC calendar fields, and our code on the workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if not any(Path(f).name == "barlight.zip" for f in sc.listFiles):
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="spark-")) / "barlight.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, Path("barlight") / f.relative_to(root))
        sc.addPyFile(str(archive))
    return spark
