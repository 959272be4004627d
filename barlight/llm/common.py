"""What the operators share: input form, registration, and folders that all machines see."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL it must agree with if there is one."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``, which driver and executors share."""
    from barlight.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def text_bytes(c: Column | str) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.encode(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "utf-8")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
