"""Documents from raw to encoded: toxicity, near and substring de-duplication, decontamination, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import decontaminate, fm_dedup, pieces, simhash, toxicity
from barlight.llm.common import shared_folder, table
from barlight.llm.queries import PIECE_MODEL, is_held_out
from barlight.session import prepare

# Bytes of a batch between Spark and its Python workers. Spark's own bound is 64 MB; each task holds several batches on both sides, outside the heap.
BATCH_BYTES = 4 << 20


def _ready(spark: SparkSession) -> SparkSession:
    """Prepared, and with batches that whole texts do not fill up to their 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3; null and empty texts are scored too, repeated rows share their fate."""
    model = toxicity.fit(docs, table(_ready(spark), sf_dir, "labels").where(~is_held_out("doc_id")))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, smallest id.

    SimHashes within two bits come first; least hashes of shingles then bring what that radius cannot reach (see README). Every link is verified.
    Texts without words are copies of each other; rows with a null id stay; a repeated id with another text is another document.
    """
    _ready(spark)
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 35 words that also starts elsewhere go from the texts; ``n_chars`` follows."""
    _ready(spark)
    out = fm_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(_ready(spark), sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text, and whether they decode to it; a null text has none, each row has its own."""
    model = pieces.ship_model(_ready(spark), PIECE_MODEL)
    out = pieces.encode(docs, model, checked=True)
    return out.select(F.col("id").alias("doc_id"), F.size("pieces").alias("n_pieces"), "pieces", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # the stages learn, hash and search; tests/llm compares them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(_ready(spark), "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
