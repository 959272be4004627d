"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.session import reliable_checkpoint

# Bound of the sample of labelled rows that lexicon, trees and calibration are fitted on.
MOST_LABELLED = 20_000
# Bounds of the lexicon: most words, and the least z-value of a word's log odds.
MOST_WORDS, LEAST_Z = 400, 3.0
# Words this far apart, or nearer, are in one another's company.
NEAR = 5
# Raw score's part in the result, so that rows on one step of the calibration keep their order.
TIE = 1e-3

# Second-person words in the four languages of the corpus.
SECOND_PERSON = ("you your yours yourself yourselves u ur du dich dir dein deine deinen deiner euch euer eure ihr sie ihnen "
                 "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro vuestra").split()
# Characters that stand for letters.
LOOKALIKE, LETTERS = "01345789@$!|€+", "oieastbgasilet"
MARKS = ".,;:?\"'()[]{}<>«»“”„*_-~#^&=/\\`…"

FEATURES = ("strong", "mild", "strong_log", "near_you", "you", "hidden", "capitals", "shouted", "exclaimed", "marks", "mixed", "log_words", "mean_word")


def _tokens(c: Column) -> Column:
    return F.split(c, "[\\x20\\x09-\\x0D]+")


def with_words(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` and the text's words as written, without marks, and with look-alike characters read as letters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    plain = F.translate(low, MARKS + "!", "")
    # a closing exclamation mark is one, not a letter
    read = F.translate(F.regexp_replace(low, "!+(?=[\\s\\p{Punct}]|$)", ""), LOOKALIKE + MARKS, LETTERS)
    return docs.withColumns({"_text": text, "_plain": _tokens(plain), "_read": _tokens(read)})


@dataclass
class Model:
    strong: list[str]
    mild: list[str]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def features(words: DataFrame, strong: list[str], mild: list[str]) -> DataFrame:
    """Adds the dense features to rows from :func:`with_words`; rates are per word or per character, so length does not matter."""
    none = ["\0"]
    is_in = lambda w, bag: w.isin(*(bag or none))
    near = lambda i: F.slice("_read", F.greatest(i + 1 - NEAR, F.lit(1)), 2 * NEAR + 1)
    counted = words.withColumns({
        "_n": F.greatest(F.size(F.filter("_read", lambda w: w != "")), F.lit(1)),
        "_strong": F.size(F.filter("_read", lambda w: is_in(w, strong))),
        "_clear": F.size(F.filter("_plain", lambda w: is_in(w, strong))),
        "_mild": F.size(F.filter("_read", lambda w: is_in(w, mild))),
        "_near": F.size(F.filter("_read", lambda w, i: is_in(w, strong) & F.exists(near(i), lambda v: is_in(v, SECOND_PERSON)))),
        "_you": F.size(F.filter("_read", lambda w: is_in(w, SECOND_PERSON))),
        "_chars": F.greatest(F.length("_text"), F.lit(1)),
        "_upper": F.length(F.regexp_replace("_text", "[^A-ZÀ-ÖØ-Þ]+", "")),
        "_shout": F.size(F.split("_text", "\\b[A-ZÀ-ÖØ-Þ]{3,}\\b")) - 1,
        "_bang": F.length("_text") - F.length(F.translate("_text", "!", "")),
        "_mark": F.length("_text") - F.length(F.translate("_text", MARKS, "")),
        "_mix": F.size(F.split("_text", "\\p{L}[0-9@$!|*€+]+(?=\\p{L})")) - 1,
    })
    n, chars = F.col("_n"), F.col("_chars")
    made = {
        "strong": F.col("_strong") / n, "mild": F.col("_mild") / n, "strong_log": F.log1p(F.col("_strong").cast("double")), "near_you": F.col("_near") / n,
        "you": F.col("_you") / n, "hidden": F.greatest(F.col("_strong") - F.col("_clear"), F.lit(0)) / n, "capitals": F.col("_upper") / chars,
        "shouted": F.col("_shout") / n, "exclaimed": F.col("_bang") / chars, "marks": F.col("_mark") / chars, "mixed": F.col("_mix") / n,
        "log_words": F.log1p(n.cast("double")), "mean_word": chars / n,
    }
    assert tuple(made) == FEATURES
    kept = [c for c in words.columns if c not in ("_text", "_plain", "_read")]
    return counted.select(*kept, *[v.alias(f"f_{k}") for k, v in made.items()])


def lexicon(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Strong and mild words of labelled rows (``_read``, ``label``), by how many texts of each label hold them."""
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    held = rows.select("label", F.explode(F.array_distinct("_read")).alias("w")).where("w != ''")
    df = held.groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (c + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = df.select("w", z.alias("z"), odds.alias("odds")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(MOST_WORDS).collect()
    return [r.w for r in top if r.odds >= 2], [r.w for r in top if r.odds < 2]


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="_features", handleInvalid="keep").transform(df)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """Lexicon, trees and calibration from at most ``most`` labelled rows, the first by a hash of the id.

    The caller passes the labels that may be learned from. Two thirds of the rows
    (by another hash) grow the trees, one third gives the isotonic steps. Rows
    with a null id, label or no document are ignored; with one label only or none,
    every score is that label's share (0 if there is no row).
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("label"))
    some = some.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "label").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id")  # at most ``most`` ids
    words = reliable_checkpoint(with_words(rows, "_t").drop("_t"))
    counts = {r[0]: r[1] for r in words.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model([], [], None, None, prior)
    strong, mild = lexicon(words)
    made = reliable_checkpoint(_vectors(features(words, strong, mild)).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("_id").cast("string")), F.lit(3)))
                               .select("label", "_features", "part").coalesce(4))
    grow, step = made.where("part > 0"), made.where("part = 0")
    if grow.select("label").distinct().count() < 2 or step.select("label").distinct().count() < 2:
        grow = step = made
    trees = GBTClassifier(labelCol="label", featuresCol="_features", predictionCol="_p", maxIter=20, maxDepth=3, stepSize=0.2, seed=7, maxBins=64, minInstancesPerNode=3).fit(grow)
    probed = trees.transform(step).select(F.col("label").cast("double").alias("label"), vector_to_array("probability")[1].alias("_raw"))
    steps = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(probed)
    return Model(strong, mild, trees, steps, prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for each row, from the whole text alone; a null text counts as empty. No shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"))
    if model.trees is None:
        return rows.select("id", F.lit(model.prior).alias("score"))
    made = _vectors(features(with_words(rows, "_t").drop("_t"), model.strong, model.mild)).select("id", "_features")
    raw = model.trees.transform(made).select("id", vector_to_array("probability")[1].alias("_raw"))
    cal = model.steps.transform(raw)
    return cal.select("id", F.least(F.greatest((1 - TIE) * F.col("_calibrated") + TIE * F.col("_raw"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def accepted(docs: DataFrame, model: Model, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, as they are."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    return scored(rows, model, "row", "text").where(F.col("score") < limit).select("id.*")
