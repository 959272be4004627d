"""Spelling variants: words one edit apart, found by pivotal grams against gram prefixes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.common import text_bytes
from barlight.llm.buckets import by_key
from barlight.session import reliable_checkpoint

LETTERS = "A-Za-zÀ-ÿ"
# Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
# Rows of one key that meet in one task; more are dealt out in blocks.
BLOCK = 16_384
# Words up to so many letters are compared in rows of this width, longer ones one by one.
WIDTH = 64
# Gram length and edits: two disjoint pivots, of which one edit leaves one; a prefix of GRAM + 1 grams holds them.
GRAM = 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, drop_every: int = 0) -> DataFrame:
    """``(word, n)``: runs of letters of whole texts with A-Z lower-cased, and how often they occur.

    Words have at least ``least_letters`` code points and ``least_count`` occurrences.
    With ``drop_every`` a run loses a letter in those documents where that number
    divides the CRC-32 of ``<id>:<run>``: the letter at that checksum modulo the run's
    length. A null text has no words, a null id counts as an empty one, repeated rows count each.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_bytes(text_col).alias("b"))
    run_of = re.compile("[%s]{%d,}" % (LETTERS, least_letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for x in batches:
            for i, b in zip(x.column(0), x.column(1)):
                runs = Counter(run_of.findall(b.as_py().lower().decode("utf-8", "replace")))  # of bytes, lower() changes A-Z only
                if drop_every:
                    seed = zlib.crc32(f"{i.as_py()}:".encode())
                    for w in [w for w in runs if not zlib.crc32(w.encode(), seed) % drop_every]:
                        n, at = runs.pop(w), zlib.crc32(w.encode(), seed) % len(w)
                        if len(w) > least_letters:
                            held[w[:at] + w[at + 1:]] += n
                for w, n in runs.items():
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield rows()
        yield rows()

    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Grams from rare to frequent, by the number of words that have them. An alphabet of 90 letters has 8,100 grams at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for x in batches:
            for w in x.column(0).to_pylist():
                n.update({w[k:k + GRAM] for k in range(len(w) - GRAM + 1)})
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: k for k, r in enumerate(sorted(rows, key=lambda r: (r.n, r.gram)))}


def prefix_and_pivots(word: str, ranks: dict[str, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """``(rank, position)`` of the word's rarest grams, and of two of them that share no letter.

    The prefix holds the ``GRAM + 1`` rarest grams and all that tie with the last of them.
    The pivots are the disjoint pair with the least sum of ranks, by dynamic programming over positions.
    """
    grams = sorted((ranks[word[k:k + GRAM]], k) for k in range(len(word) - GRAM + 1))
    last = grams[min(GRAM, len(grams) - 1)][0]
    prefix = [g for g in grams if g[0] <= last]
    by_place = sorted(prefix, key=lambda g: g[1])
    best, ahead, first = None, 0, None  # first: rarest gram that ends before the one at hand
    for rank, at in by_place:
        while by_place[ahead][1] + GRAM <= at:
            first = min(first or by_place[ahead], by_place[ahead])
            ahead += 1
        if first is not None:
            pair = (first[0] + rank, first, (rank, at))
            best = min(best or pair, pair)
    return prefix, [] if best is None else list(best[1:])


def _signature(word: str) -> int:
    """Bit c is set if an odd number of the word's code points are c modulo 64: one edit changes two bits at most."""
    x = 0
    for c in word:
        x ^= 1 << (ord(c) & 63)
    return x - (1 << 64) if x >> 63 else x


def _entries(ranks: dict[str, int], whole: bool):
    """Rows ``key, side, last, sig, word, n``: each word by its pivots (side 0) and by the places where another word's pivot may meet its prefix (side 1).

    A gram that one edit leaves moves by no place, or by one if the lengths differ; the key holds gram, place and
    length of the pivot's word. Not ``whole``: only how many rows each key and side has.
    """
    moves = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            words = x.column(0).to_pylist()
            key, side, last, of, sig = [], [], [], [], []
            for k, w in enumerate(words):
                prefix, pivots = prefix_and_pivots(w, ranks)
                size, most = len(w), prefix[-1][0]
                made = {(rank, at, size, 0) for rank, at in pivots}
                made |= {(rank, at + by, size + d, 1) for rank, at in prefix for d, by in moves if at + by >= 0 and at + by + GRAM <= size + d}
                for rank, at, length, s in made:
                    key.append((rank + 10_007 * (at + 1_000_003 * length)) & (2**63 - 1))
                    side.append(s)
                    of.append(k)
                last += [most] * len(made)
                sig += [_signature(w)] * len(made)
            key, side = np.array(key, np.int64), np.array(side, np.int64)
            if whole:
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(last, pa.int64()), pa.array(sig, pa.int64()), x.column(0).take(at), x.column(1).take(at)], ["key", "side", "last", "sig", "word", "n"])
            else:
                keys, at = np.unique(key, return_inverse=True)
                n = np.bincount(2 * at + side, minlength=2 * len(keys)).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n[:, 0]), pa.array(n[:, 1])], ["key", "n0", "n1"])

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return (a[k + 1:] == b[k + 1:] and k < len(b)) if len(a) == len(b) else len(a) == len(b) + 1 and a[k + 1:] == b[k:]


def _verified(words: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """:func:`one_edit` of many pairs of positions in ``words``."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(i), dtype=bool)
    small = (size[i] <= WIDTH) & (size[j] <= WIDTH)
    for k in np.flatnonzero(~small).tolist():
        out[k] = one_edit(words[i[k]], words[j[k]])
    code = np.array([w if len(w) <= WIDTH else "" for w in words], dtype=f"<U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    places = np.arange(WIDTH - 1)
    small = np.flatnonzero(small)
    for k in range(0, len(small), 1 << 15):
        at = small[k:k + (1 << 15)]
        swap = size[i[at]] < size[j[at]]
        p, q = np.where(swap, j[at], i[at]), np.where(swap, i[at], j[at])
        a, b = code[p], code[q]
        differ = a != b
        moved = (a[:, 1:] != b[:, :-1]) & (places >= differ.argmax(axis=1)[:, None])
        out[at] = np.where(size[p] == size[q], differ.sum(axis=1) == 1, (size[p] == size[q] + 1) & ~moved.any(axis=1))
    return out


def _met(t: pa.Table) -> pa.RecordBatch:
    """Rows sorted by key, each key whole: its pivots against its prefixes, verified; each pair of the call once, smaller word first."""
    key, side, last, sig = (t.column(c).to_numpy() for c in ("key", "side", "last", "sig"))
    sig = sig.view(np.uint64)  # bitwise_count counts the bits of the absolute value
    order = np.lexsort((side, key))
    edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        cut = a + int(np.searchsorted(side[order[a:b]], 1))
        if a == cut or cut == b:
            continue
        s = order[cut:b]
        for c in range(a, cut, 256):
            r = order[c:min(cut, c + 256)]
            x, y = np.nonzero((np.bitwise_count(sig[r][:, None] ^ sig[s][None, :]) <= 2) & (last[r][:, None] <= last[s][None, :]))
            left.append(r[x])
            right.append(s[y])
    i, j = np.concatenate(left), np.concatenate(right)
    word = t.column("word").combine_chunks().dictionary_encode()
    names = word.dictionary.to_pylist()
    own = word.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.zeros(len(names), np.int64)
    n[own] = t.column("n").to_numpy()
    i, j = own[i], own[j]
    pairs = np.unique(np.minimum(i, j)[i != j] * len(names) + np.maximum(i, j)[i != j])
    i, j = pairs // max(len(names), 1), pairs % max(len(names), 1)
    ok = _verified(names, i, j) if len(i) else np.zeros(0, bool)
    i, j = i[ok], j[ok]
    swap = np.fromiter((names[a] > names[b] for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    take = lambda at: word.dictionary.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([take(i), pa.array(n[i]), take(j), pa.array(n[j])], ["a", "na", "b", "nb"])


def near_words(words: DataFrame) -> DataFrame:
    """``(a, na, b, nb)``: each pair of ``words`` (``word``, ``n``; distinct, of five code points or more) that one edit parts, once, with their counts.

    Of two such words let the one whose prefix ends earlier in the order of grams be
    the first. One edit touches one of its two disjoint pivots at most; the other is
    a gram of the second word too, at the same place or one beside, and not later in
    the order than the second's prefix ends, so the second's prefix has it. Keys of
    gram, place and length bring the two together; letters' parities prune, letters decide.
    Keys with over ``BLOCK`` rows on a side are dealt out in blocks, every block of one side against every block of the other.
    """
    ranks = gram_ranks(words)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.select("word", "n").mapInArrow(_entries(ranks, True), "key long, side long, last long, sig long, word string, n long")
    sizes = words.select("word", "n").mapInArrow(_entries(ranks, False), "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    hot = reliable_checkpoint(sizes.where((F.greatest("n0", "n1") > BLOCK) & (F.least("n0", "n1") > 0)))
    if not hot.isEmpty():
        blocks = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / BLOCK).cast("int")
        dealt = rows.join(hot, "key", "left").withColumns({"b0": blocks("n0"), "b1": blocks("n1")})
        own = F.pmod(F.xxhash64("word"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1")))
        other = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)
        dealt = dealt.withColumn("other", F.explode(F.when(F.col("n0").isNull(), F.array(F.lit(-1))).otherwise(other)))
        place = F.when(F.col("side") == 0, F.struct(own.alias("x"), F.col("other").cast("long").alias("y"))).otherwise(F.struct(F.col("other").cast("long").alias("x"), own.alias("y")))
        rows = dealt.withColumn("key", F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", place))).select(*rows.columns)
    met = rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(by_key(rows.columns, _met), "a string, na long, b string, nb long")
    return met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")).select("a", "na", "b", "nb")


def variants(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for each of ``words`` (``word``, ``n``).

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them
    (ties: smallest in code-point order) if it is at least twice as frequent, else
    null; ``root`` is where the forms lead, the word itself without one. Counts double
    along forms, so they never turn back, and pointers are doubled, so few rounds end them.
    """
    words = reliable_checkpoint(words.select("word", "n"))
    pairs = reliable_checkpoint(near_words(words))
    each = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")).unionAll(pairs.select("b", "a", "na"))
    best = each.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    fits = -F.col("best.m") >= 2 * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                  F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    out = reliable_checkpoint(out)
    at = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        at = reliable_checkpoint(at.join(far, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.select("word", "root")
    return out.join(at.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
