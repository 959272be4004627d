"""Importance resampling towards a target: hashed word features, gains of buckets, Gumbel noise and a distributed draw."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.common import text_bytes
from barlight.session import reliable_checkpoint

# ASCII other than digits and letters parts words; every other character belongs to one.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Text bytes that one round of kernels takes (one text at least).
ROUND_BYTES = 4 << 20
# Words up to so many bytes have a shift table; a pair with a longer second word is hashed byte by byte.
SHIFTED = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _shift_tables(longest: int) -> np.ndarray:
    """``[n, k, byte]``: the effect of byte k of a checksum once n zero bytes follow."""
    step, out = _crc_table(), np.empty((longest + 1, 4, 256), dtype=np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * np.uint32(8))
    for n in range(longest + 1):
        out[n] = now
        now = (now >> np.uint32(8)) ^ step[now & 255]
    return out


_SHIFTS = _shift_tables(SHIFTED + 1)


def _joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row, from theirs and the second's length (``SHIFTED`` + 1 at most)."""
    out = second.copy()
    for k in range(4):
        out ^= _SHIFTS[length, k, (first >> np.uint32(8 * k)) & 255]
    return out


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words a text, text of each feature, bucket of each feature)`` for all words and pairs of neighbouring words.

    Words are dictionary indices; two neighbouring ones make a pair number, and each distinct word and pair is hashed once.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BREAK)
    of, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.not_equal(flat, "")
    of, flat = of.filter(keep).to_numpy(zero_copy_only=False), flat.filter(keep)
    n_words = np.bincount(of, minlength=len(texts))
    if not len(flat):
        return n_words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    at, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [w.encode() for w in coded.dictionary.to_pylist()]
    alone = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
    size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    one = pc.take(pa.array(alone.astype(np.int64) % buckets), pa.array(at)).to_numpy(zero_copy_only=False)
    inside = np.flatnonzero(of[1:] == of[:-1])
    pairs = pa.array(at[inside] * len(words) + at[inside + 1]).dictionary_encode()
    distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
    a, b = distinct // len(words), distinct % len(words)
    crc = _joined_crc(alone[a], spaced[b], np.minimum(size[b], SHIFTED + 1))
    for k in np.flatnonzero(size[b] > SHIFTED + 1).tolist():
        crc[k] = zlib.crc32(b" " + words[b[k]], int(alone[a[k]]))
    two = pc.take(pa.array(crc.astype(np.int64) % buckets), pairs.indices).to_numpy(zero_copy_only=False)
    return n_words, np.concatenate([of, of[inside]]).astype(np.int64), np.concatenate([one, two])


def _rounds(x: pa.RecordBatch, text: str) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch with about ``ROUND_BYTES`` of text, each with its first row."""
    col = x.column(text).cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ROUND_BYTES, "right")))
        yield a, col.slice(a, b - a)
        a = b


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> tuple[np.ndarray, int]:
    """Features of all texts by bucket, and their number. The driver gets one number a bucket, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for x in batches:
            for _, texts in _rounds(x, "text"):
                total += np.bincount(_features(texts, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out, int(out.sum())


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    """Per bucket the floored thousandfold logarithm of its smoothed share in the target over that in the documents."""
    s, all_s = bucket_counts(docs, text_col, buckets)
    t, all_t = bucket_counts(target, target_text_col, buckets)
    up, down = (t + 1.0) * float(all_s + buckets), (s + 1.0) * float(all_t + buckets)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, n_words, n_features, weight)`` per row; ``th`` is a hash of the text, ``weight`` the floored mean gain."""
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_bytes(text_col)).alias("th"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            words, weight = np.zeros(x.num_rows, np.int64), np.zeros(x.num_rows, np.int64)
            for a, texts in _rounds(x, "text"):
                n, of, bucket = _features(texts, len(gain))
                order = np.argsort(of, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
                words[a:a + len(n)] = n
                weight[a:a + len(n)] = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(np.diff(ends), 1)
            features = words + np.maximum(words - 1, 0)
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("th"), *[pa.array(c, pa.int64()) for c in (words, features, weight)]], ["id", "th", "n_words", "n_features", "weight"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, th long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of a row in thousandths, floored: from the first 32 bits of a digest of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with their ``rank`` by falling score and rising id (null ids last); ranges are sorted apart, only their sizes reach the driver."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("th")]
    laid = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    laid = reliable_checkpoint(laid)
    part = F.shiftright("place", 33)
    sizes = {r.part: r.n for r in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    first = F.get(F.array(*[F.lit(b).cast("long") for b in offsets or [0]]), part.cast("int"))
    return laid.withColumn("rank", first + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("place")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
              id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``(id, th, n_words, n_features, weight, score, rank)`` per row of ``docs``: which documents an importance draw towards ``target`` takes, and in which order.

    Features are the words and the pairs of neighbouring words of whole texts
    (A-Z lower-cased; words hold digits, letters and all non-ASCII characters),
    hashed into ``buckets``; counts cover all documents and all target texts. Of the
    rows with ``least_words`` words or more, ``percent`` in a hundred (floored) are
    drawn without replacement: the highest of weight plus noise, ties to the smaller
    id. ``rank`` counts from 1; rows not drawn have none.

    A null or empty text has no feature and weight 0. A null id is hashed as an
    empty one and comes last among ties; repeated rows are rows of their own, with
    the noise of their id. No documents give no rows; no target gives the gains of
    an empty one. Other columns are ignored.
    """
    src = weighted(docs, gains(docs, target, buckets, text_col, target_text_col), id_col, text_col)
    rows = reliable_checkpoint(src.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    fits = F.col("n_words") >= least_words
    most = rows.where(fits).count() * percent // 100
    ranked = _ranked(rows.where(fits), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionByName(rows.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that :func:`resampled` draws, with all their columns; of rows that are alike in id and text all come if one is drawn."""
    taken = resampled(docs, target, id_col=id_col, text_col=text_col, **how).where("rank is not null").select(F.struct("id", "th").alias("key")).distinct()
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_bytes(text_col)).alias("th"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own"))
    return row.join(taken, F.col("own").eqNullSafe(F.col("key")), "left_semi").select("row.*")
