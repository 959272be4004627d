"""SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.anchors import mixed
from barlight.llm.buckets import by_key, links_in_buckets, signature
from barlight.llm.common import text_bytes
from barlight.llm.components import components
from barlight.session import reliable_checkpoint

# Buckets up to this size are checked pair by pair; larger ones go by shared neighbours.
BUCKET = 64


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    text = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(text, 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return np.array([xxh64_intdigest(text[a:b - 1], 42) for a, b in zip(starts, ends[size - 1:], strict=False)], dtype=np.uint64)


def _majority(h: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 18):
        ones += np.unpackbits(h[k:k + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: 64-bit SimHash of the word shingles, repeats included.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space.
    Fewer words than a shingle make one shingle, no word the fingerprint zero;
    a null text counts as empty. Texts of any length are taken whole.
    """
    src = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = [_majority(_hashes(b.as_py().lower().split(), shingle)) for b in x.column(1)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


@dataclass(frozen=True)
class Ring:
    """A fingerprint's segments on a ring, and the radius they share.

    Pigeonring: if two fingerprints differ in at most ``radius`` bits, some
    segment begins a chain whose every prefix of k segments differs in at most
    k * radius / segments bits. While that share is below 1 the segments are equal;
    while it is below 2 all but one are. ``keys`` lists the sets of segments of
    which one must be equal.
    """

    segments: int
    radius: int

    def edges(self) -> list[int]:
        return [64 * k // self.segments for k in range(self.segments + 1)]

    def keys(self) -> list[tuple[int, ...]]:
        m, r = self.segments, self.radius
        equal = max(k for k in range(m + 1) if k * r < m)
        nearly = max(k for k in range(m + 1) if k * r < 2 * m)
        out = set()
        for i in range(m):
            ring = [(i + k) % m for k in range(nearly)]
            for skip in range(equal, nearly):
                out.add(tuple(sorted(ring[:skip] + ring[skip + 1:])))
        return sorted(out)

    def columns(self, fp) -> list:
        """For each key set a column: its number above the bits of its segments."""
        e = self.edges()
        seg = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(e[:-1], e[1:], strict=True)]
        out = []
        for n, at in enumerate(self.keys()):
            key = F.lit(n).cast("long")
            for k in at:
                key = F.shiftleft(key, e[k + 1] - e[k]).bitwiseOR(seg[k])
            out.append(key)
        return out

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Differing bits per segment, for xor values."""
        e = self.edges()
        return np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)) for a, b in zip(e[:-1], e[1:], strict=True)]).astype(np.int16)

    def viable(self, d: np.ndarray) -> np.ndarray:
        """Whether some start has a chain whose every prefix stays within its share."""
        m, ok = len(d), np.zeros(d.shape[1], dtype=bool)
        for i in range(m):
            here, total = np.ones(d.shape[1], dtype=bool), np.zeros(d.shape[1], dtype=np.int16)
            for k in range(m):
                total = total + d[(i + k) % m]
                here &= total * m <= (k + 1) * self.radius
            ok |= here
        return ok


# Four segments of 16 bits and two differing bits: segment 0 of a chain is equal, and one of the next two.
STRICT = Ring(4, 2)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what no earlier link of this task has joined."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def _check_buckets(ring: Ring, span: bool):
    """Rows ``key, fp, rep`` sorted by key: links between representatives within the radius; with ``span`` only as many as join the same."""
    names = ["key", "fp", "rep"]

    def links(t: pa.Table) -> pa.RecordBatch:
        key, fp, rep = (t.column(n).to_numpy() for n in names)
        fp = fp.view(np.uint64)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, BUCKET):
            at = np.flatnonzero(key[:-step] == key[step:])
            if not len(at):
                break
            x = fp[at] ^ fp[at + step]
            at = at[ring.viable(ring.differences(x))]
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= ring.radius]
            out_a.append(np.minimum(rep[at], rep[at + step]))
            out_b.append(np.maximum(rep[at], rep[at + step]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        a, b = _forest(a, b) if span else np.unique(np.stack([a, b], 1), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return by_key(names, links)


def _keyed(rows: DataFrame, keys: Column, name: str) -> DataFrame:
    """Rows ``key, n, rep`` and the column ``name`` of the keys that two or more of ``rows`` have."""
    keyed = rows.select(name, "rep", F.explode(keys).alias("key"))
    sizes = reliable_checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return reliable_checkpoint(keyed.join(sizes, "key"))


def _small(at: DataFrame, most: int, name: str) -> DataFrame:
    parts = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return at.where(F.col("n") <= most).select("key", name, "rep").repartition(parts, "key").sortWithinPartitions("key")


def linked(fps: DataFrame) -> DataFrame:
    """``(u, v)``: links among distinct fingerprints ``(fp, rep)`` that span all pairs within two bits.

    Equal key segments (:class:`Ring`) make the buckets, the chain test prunes
    inside them, the full distance decides. Buckets with over ``BUCKET``
    fingerprints are not compared pair by pair: each member gives itself and its
    64 one-bit neighbours, and fingerprints that share such a point are within two
    bits, and the reverse. Nothing is left out.
    """
    at = _keyed(fps, F.array(*STRICT.columns(F.col("fp"))), "fp")
    by_bucket = _small(at, BUCKET, "fp").mapInArrow(_check_buckets(STRICT, True), "u long, v long")
    points = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    hot = at.where(F.col("n") > BUCKET).select("fp", "rep").distinct()
    near = hot.select("rep", F.explode(F.transform(points, lambda p: F.col("fp").bitwiseXOR(p))).alias("point"))
    least = near.groupBy("point").agg(F.min("rep").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "v")
    by_point = near.join(least, "point").where(F.col("rep") != F.col("v")).select(F.col("rep").alias("u"), "v").distinct()
    return by_bucket.unionAll(by_point)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp, component)`` per row: the smallest id reachable over fingerprints within two bits.

    Equal fingerprints stand for one another, so copies never meet as pairs. Rows
    with a null id get their fingerprint and a null component, and link nothing;
    nodes are fingerprints, so a repeated id with another text is a document of its
    own. No rows give no rows. Other columns are ignored.
    """
    fp = reliable_checkpoint(fingerprints(docs, id_col, text_col, shingle))
    distinct = reliable_checkpoint(fp.where("id is not null").groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("least")))
    comp = components(linked(distinct.select("fp", F.col("fp").alias("rep")))).toDF("fp", "label")
    of = distinct.join(comp, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = of.groupBy("label").agg(F.min("least").alias("component"))
    out = fp.join(of.join(least, "label").select("fp", "component"), "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


# Band keys of similar texts: each is made of so many least hashes of the shingles. A pair of similarity s shares none
# with probability (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8, however the shingles that differ lie in the texts.
BANDS, ROWS = 32, 5
_TIMES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _bands(h: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of hashes; none for an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(h), 4096):
        least = np.minimum(least, (_TIMES[:, None] * h[None, k:k + 4096]).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = mixed(key ^ row)
    return key.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, th, same, fp, bands)``: a digest of the lower-cased words in order, the SimHash of the word shingles and the band keys of the distinct ones."""
    from xxhash import xxh3_128_digest

    b = text_bytes(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(b).alias("th"), b.alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            same, fp, bands = [], [], []
            for b in x.column("b"):
                words = b.as_py().lower().split()
                same.append(xxh3_128_digest(b" ".join(words)))
                h = _hashes(words, size)
                fp.append(_majority(h))
                bands.append(_bands(np.unique(h)))
            yield pa.RecordBatch.from_arrays([x.column("id"), x.column("th"), pa.array(same, pa.binary()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "th", "same", "fp", "bands"])

    return src.mapInArrow(run, "id long, th long, same binary, fp long, bands array<long>")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``(node, n, hs, sig)`` of rows ``(node, b)``: number, hashes and signature of the distinct word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [np.unique(_hashes(b.as_py().lower().split(), size)).view(np.int64) for b in x.column("b")]
            yield pa.RecordBatch.from_arrays([x.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(list(map(signature, sets)), pa.binary())], ["node", "n", "hs", "sig"])

    return docs.mapInArrow(run, "node long, n long, hs array<long>, sig binary")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """``(id, th, component)`` per row with an id: documents linked by a similarity of ``similar`` or more of their sets of word shingles.

    SimHash comes first: fingerprints of the shingles within two bits (:func:`linked`) are candidates, verified exactly,
    and what they join is not compared again. Its radius cannot reach that similarity, so texts that share one
    of the ``BANDS`` keys of their shingles (least hashes) are compared by :func:`links_in_buckets` for the rest, and
    verified too. Equal word sequences are one node, whatever their
    ids, and a repeated id with another text is a node of its own; nodes are known by a
    64-bit digest, and a group by its smallest id. Ids must be whole numbers; null ids are
    left out, so such rows are in no group. Texts without words are copies of each other.
    """
    ratio = Fraction(similar).limit_denominator(1_000)
    sk = reliable_checkpoint(_sketches(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle).withColumn("same", F.xxhash64("same")))
    reps = reliable_checkpoint(sk.groupBy("same").agg(F.min(F.struct("id", "th")).alias("r"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keyed = reps.select(F.col("same").alias("node"), F.explode("bands").alias("key"))
    sizes = reliable_checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    entries = reliable_checkpoint(keyed.join(sizes, "key"))
    prints = reliable_checkpoint(reps.groupBy("fp").agg(F.min("same").alias("rep")))
    equal = reps.join(prints, "fp").where(F.col("same") != F.col("rep")).select(F.col("same").alias("u"), F.col("rep").alias("v"))
    pairs = reliable_checkpoint(equal.unionAll(linked(prints)))
    met = entries.select("node").unionAll(pairs.select("u")).unionAll(pairs.select("v")).toDF("same").distinct()
    wanted = reliable_checkpoint(reps.join(met, "same").select(F.col("same").alias("node"), F.col("r.id").alias("i"), F.col("r.th").alias("t")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("b")).withColumn("th", F.xxhash64("b"))
    found = texts.join(wanted, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).select("node", "b")
    rows = reliable_checkpoint(_shingle_sets(found, shingle).dropDuplicates(["node"]))
    nothing = F.lit(0).cast("long")
    members = entries.join(rows.select("node", "n", "sig"), "node").withColumns({"u": nothing, "pos": nothing})
    links = links_in_buckets(rows, reliable_checkpoint(members), ratio.numerator, ratio.denominator, pairs)
    comp = reliable_checkpoint(components(links)).toDF("same", "label")
    labelled = sk.select("id", "th", "same").join(comp, "same", "left").withColumn("label", F.coalesce("label", "same"))
    least = labelled.groupBy("label").agg(F.min("id").alias("component"))
    return labelled.join(least, "label").select("id", "th", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller id; rows with a null id stay, and so do repeated rows of the smallest id."""
    gone = similar_groups(docs, id_col, text_col).where(F.col("id") != F.col("component")).select(F.struct("id", "th").alias("key")).distinct()
    key = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_bytes(text_col)).alias("th"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("own"))
    return rows.join(gone, F.col("own") == F.col("key"), "left_anti").select("row.*")
