"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.common import ascii_lower
from barlight.session import reliable_checkpoint

WORD_SPACE = "[\\x20\\x09-\\x0D]+"
SHINGLE = 5
# Fingerprints within this many bits meet; one block more than that guarantees an equal block.
RADIUS = 15
SIMILAR = 0.8
# Items of one pass and their words: its shingles and blocks are broadcast, so both are bounded; more take more passes.
ITEMS_A_PASS, WORDS_A_PASS = 5_000, 1_000_000
# Longer items, in words, are not broadcast: they share a pass of shuffled joins.
ITEM_WORDS = 2_000


def words_of(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), WORD_SPACE), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Word shingles as texts, repeats included; fewer words give one shingle of all, none gives none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def simhash(hashes: Column) -> Column:
    """Bit b is 1 if over half of the hashes have it; no hashes give zero."""
    def bit(b: int) -> Column:
        value = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        having = F.size(F.filter(hashes, lambda h: h.bitwiseAND(value) != 0))
        return F.when(2 * having > F.size(hashes), value).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), [bit(b) for b in range(64)])


def blocks_of(fp: Column) -> Column:
    """The fingerprint in ``RADIUS + 1`` blocks, each with its number: within the radius at least one is equal."""
    m = RADIUS + 1
    edge = [64 * k // m for k in range(m + 1)]
    return F.array(*[F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * m + k for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))])


def bag_of(shingles: Column) -> Column:
    """The shingles, each with its number among its equals: bags as sets of texts."""
    def numbered(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        runs = lambda at: F.transform(at, lambda p, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s) + 1) - p), lambda c: F.concat(F.lpad(c.cast("string"), TAG, "0"), F.get(s, p - 1))))
        return F.flatten(F.get(F.transform(F.array(starts), runs), 0))

    ordered = F.transform(F.array(F.sort_array(shingles)), numbered)
    return F.when(F.size(shingles) > 0, F.get(ordered, 0)).otherwise(F.array().cast("array<string>"))


# Digits of a number in a bag.
TAG = 10


def _weight(bag: Column) -> Column:
    return F.aggregate(bag, F.lit(0).cast("long"), lambda x, s: x + F.length(s) - TAG)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two bags of shingles; a shingle weighs its length."""
    met = _weight(F.array_intersect(a, b))
    return met / F.greatest(_weight(a) + _weight(b) - met, F.lit(1).cast("long"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, th, item, start, n_words, similarity)``: for each document and item the best window of the item's size at ``SIMILAR`` or more.

    1. Windows lie where a document shares a shingle with an item, aligned on it; any other window has similarity 0.
       Items below the shingle length have one shingle, all their words: each window of their size that equals it counts.
    2. Windows and items get a SimHash; equal blocks bring all pairs within ``RADIUS`` bits together, the distance is then checked.
    3. The exact similarity of their shingles decides; ties go to the smaller start.

    Words are lower-cased (A-Z) runs without white space. Null or empty texts and
    items have no shingle and match nothing; each text with a null id is an item of
    its own; items over ``ITEM_WORDS`` words meet by shuffled joins and need no
    SimHash; repeated rows count once; equal ids with different
    texts (``th`` is a hash of the text) have their own rows. Empty tables give no rows. Other columns are ignored.
    """
    w = words_of(F.col(item_text_col))
    known = items.select(F.col(item_col).alias("item"), w.alias("iw")).where(F.size("iw") > 0).distinct()
    key = F.xxhash64("item", F.array_join("iw", " "))
    known = reliable_checkpoint(known.select("item", key.alias("key"), F.when(F.col("item").isNull(), key).alias("own"), F.size("iw").alias("size"), shingles_of(F.col("iw")).alias("item_shingles")))
    usual = F.col("size") <= ITEM_WORDS
    n, words, longer, short = known.agg(F.count(F.when(usual, 1)), F.sum(F.when(usual, F.col("size"))), F.count(F.when(~usual, 1)), F.collect_set(F.when(F.col("size") < SHINGLE, F.col("size")))).first()
    passes = max(1, -(-n // ITEMS_A_PASS), -(-(words or 0) // WORDS_A_PASS))
    numbered = known.where(usual).withColumn("pass", F.pmod("key", F.lit(passes)) if passes > 1 else F.lit(0))
    found = [_one_pass(docs, numbered.where((F.col("pass") == p) & (F.col("size") >= SHINGLE)), id_col, text_col) for p in range(passes)]
    if longer:
        found.append(_long_items(docs, known.where(~usual & (F.col("size") >= SHINGLE)), id_col, text_col))
    if short:
        found += [_short_items(docs, numbered.where((F.col("pass") == p) & (F.col("size") < SHINGLE)), sorted(short), id_col, text_col) for p in range(passes)]
    every = reduce(DataFrame.unionAll, found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), (-F.col("n_words")).alias("w"))).alias("m")
    out = every.groupBy("id", "th", "item", "own").agg(best)
    return out.select("id", "th", "item", (-F.col("m.s")).alias("start"), (-F.col("m.w")).alias("n_words"), F.col("m.similarity").alias("similarity"))


def _short_items(docs: DataFrame, known: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """Items below the shingle length: a window of their size has one shingle too, so it equals theirs or has similarity 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("w"))

    def windows(size: int) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
        return src.where(F.size("w") >= size).select("id", "th", F.lit(size).alias("n_words"), F.posexplode(every).alias("start", "s"))

    texts = known.select("item", "own", F.col("size").alias("n_words"), F.col("item_shingles")[0].alias("s"))
    met = reduce(DataFrame.unionAll, [windows(size) for size in sizes]).join(F.broadcast(texts), ["n_words", "s"])
    first = met.groupBy("id", "th", "item", "own", "n_words").agg(F.min("start").alias("start"))
    return first.select("id", "th", "item", "own", "start", "n_words", F.lit(1.0).alias("similarity"))


def _windows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """Rows ``id, th, start, n_words, shingles``: the windows aligned on a shared shingle; unless ``small``, by shuffled joins and with the item's ``key``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # hashes of the words' shingles
    w, n = F.col("w"), F.size("w")
    chain = lambda i: F.xxhash64(*[F.try_element_at(w, i + k) for k in range(SHINGLE)])
    at = src.select("id", "th", words_of(F.col("text")).alias("w")).where(n >= SHINGLE)
    marks = at.select("id", "th", F.posexplode(F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), chain)).alias("p", "h"))
    own = [] if small else ["key"]
    iw = known.select("size", *own, F.posexplode("item_shingles").alias("o", "s")).select("size", *own, "o", F.split("s", " ").alias("w"))
    keys = iw.select("size", *own, "o", chain(F.lit(1)).alias("h")).distinct()
    start = F.greatest(F.col("p") - F.col("o"), F.lit(0))
    hits = marks.join(F.broadcast(keys) if small else keys, "h").select("id", "th", start.alias("start"), (F.col("p") - F.col("o") + F.col("size")).alias("end"), *own).distinct()
    hits = hits.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end", *own)).alias("at")).select(F.col("id").alias("id2"), F.col("th").alias("th2"), "at")
    met = src.join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", words_of(F.col("text")).alias("w"), "at")
    cut = met.select("id", "th", "w", F.explode("at").alias("x"))
    win = F.slice("w", F.col("x.start") + 1, F.greatest(F.least(F.col("x.end"), F.size("w")) - F.col("x.start"), F.lit(0)))
    windows = cut.select("id", "th", F.col("x.start").alias("start"), *[F.col(f"x.{c}").alias(c) for c in own], win.alias("win"))
    return windows.select("id", "th", "start", *own, F.size("win").alias("n_words"), shingles_of(F.col("win")).alias("shingles"))


def _judged(pairs: DataFrame) -> DataFrame:
    bags = pairs.withColumn("similarity", similarity(bag_of(F.col("shingles")), bag_of(F.col("item_shingles"))))
    return bags.where(F.col("similarity") >= SIMILAR).select("id", "th", "item", "own", "start", "n_words", "similarity")


def _long_items(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Few items, many words: each window keeps its item, and all whose weight allows the similarity are compared."""
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, s: x + F.length(s))
    windows = _windows(docs, known, id_col, text_col, False).withColumn("weight", weight("shingles"))
    texts = known.select("key", "item", "own", "item_shingles", weight("item_shingles").alias("item_weight"))
    met = windows.join(texts, "key").where(F.least("weight", "item_weight") >= SIMILAR * F.greatest("weight", "item_weight"))
    return _judged(met)


def _one_pass(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    windows = _windows(docs, known, id_col, text_col, True)
    windows = windows.withColumn("fp", simhash(F.transform("shingles", lambda s: F.xxhash64(s))))
    targets = known.select("key", "item", "own", "item_shingles", simhash(F.transform("item_shingles", lambda s: F.xxhash64(s))).alias("item_fp"))
    left = windows.select("*", F.explode(blocks_of(F.col("fp"))).alias("block"))
    right = targets.select("key", "item_fp", F.explode(blocks_of(F.col("item_fp"))).alias("block"))
    near = left.join(F.broadcast(right), "block").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("id", "th", "start", "n_words", "shingles", "key").distinct()
    return _judged(near.join(F.broadcast(targets.select("key", "item", "own", "item_shingles")), "key"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, as they are; null and empty texts stay, repeated rows go or stay together."""
    found = contaminated(docs, items, id_col, text_col, item_col, item_text_col).select(F.struct("id", "th").alias("key")).distinct()
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own"))
    return rows.join(found, F.col("own").eqNullSafe(F.col("key")), "left_anti").select("row.*")
