"""Long repeats across a corpus: where they can be, which shard decides on them, and what to remove.

Windows of a fixed number of tokens are brought together by their content anchor
(:mod:`barlight.llm.anchors`); a shard of anchors is then decided by an index
over its own text. The index is the caller's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm import anchors
from barlight.llm.common import text_bytes
from barlight.session import reliable_checkpoint

# Tokens that one index of a task holds.
INDEX_TOKENS = 1_000_000
# Places of one anchor up to which its windows go to an index; a more frequent anchor's are
# merged window by window, which combines before the shuffle.
FREQUENT = 512
# Bytes of text in a bucket, which a task holds at once; the number of buckets follows from it.
BUCKET_BYTES = 32 << 20


@dataclass(frozen=True)
class Law:
    """What counts as a repeat: ``width`` tokens (bytes or words) that start elsewhere, or (``keep_first``) that start earlier."""

    width: int
    gram: int
    words: bool
    keep_first: bool


class Tokens:
    """A text's tokens: their hashes, and the bytes of any stretch of them."""

    def __init__(self, law: Law, b: bytes):
        if law.words:
            self.text = b" ".join(b.split())
            gaps = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32)
            self.starts = np.concatenate([np.zeros(1, np.int64), gaps + 1]) if self.text else np.zeros(0, np.int64)
            self.ends = np.append(gaps, len(self.text)) if self.text else self.starts
            self.hashes = anchors.word_hashes(self.text, self.starts, self.ends)
        else:
            self.text, self.hashes, self.starts, self.ends = b, anchors.byte_hashes(b), None, None

    def stretch(self, a: int, b: int) -> bytes:
        return self.text[a:b] if self.starts is None else self.text[self.starts[a]:self.ends[b - 1]]

    def kept(self, keep: np.ndarray) -> bytes:
        """The kept tokens; words are joined by single spaces."""
        if self.starts is None:
            return np.frombuffer(self.text, np.uint8)[keep].tobytes()
        if not len(keep):
            return b""
        mask = np.repeat(keep, self.ends - self.starts + 1)
        return np.frombuffer(self.text + b" ", np.uint8)[mask].tobytes()[:-1]


def _anchors(docs: DataFrame, notes: DataFrame, law: Law, parts: int) -> DataFrame:
    """``(part, bucket, keys, ns)``: the distinct anchors of each bucket of texts, packed by ``key mod parts``, and at how many places they are."""
    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        later = _copies(own)
        found = [anchors.anchor_keys(Tokens(law, b).hashes, law.width, law.gram) for i, th, b in _rows(texts) if (i, th) not in later]
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        keys, n = keys[order], np.minimum(n[order], 65_535).astype(np.uint16)
        full = [p for p in range(parts) if cut[p + 1] > cut[p]]
        at = int(texts.column("bucket")[0].as_py()) if texts.num_rows else 0
        return pa.table({"part": pa.array(full, pa.int32()), "bucket": pa.array([at] * len(full), pa.int32()),
                         "keys": pa.array([keys[cut[p]:cut[p + 1]].tobytes() for p in full], pa.binary()), "ns": pa.array([n[cut[p]:cut[p + 1]].tobytes() for p in full], pa.binary())})

    return docs.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(run, "part int, bucket int, keys binary, ns binary")


def _shared(packed: DataFrame, parts: int) -> DataFrame:
    """``(bucket, keys, ns)``: each bucket's anchors that are at two places or more in the corpus, with the number of places (65,535 at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for x in batches:
            for p, at, k, n in zip(*(x.column(c).to_pylist() for c in ("part", "bucket", "keys", "ns")), strict=True):
                held.setdefault(p, []).append((at, k, n))
        for p in list(held):
            rows = held.pop(p)
            keys = np.concatenate([np.frombuffer(k, np.uint64) for _, k, _ in rows])
            ns = np.concatenate([np.frombuffer(n, np.uint16) for _, _, n in rows]).astype(np.int64)
            _, of = np.unique(keys, return_inverse=True)
            total = np.bincount(of, ns).astype(np.int64)[of]
            ends = np.cumsum([len(k) // 8 for _, k, _ in rows]).tolist()
            out = {"bucket": [], "keys": [], "ns": []}
            for (at, _, _), a, b in zip(rows, [0, *ends[:-1]], ends, strict=True):
                hot = total[a:b] > 1
                out["bucket"].append(at)
                out["keys"].append(keys[a:b][hot].tobytes())
                out["ns"].append(np.minimum(total[a:b][hot], 65_535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["ns"], pa.binary())], ["bucket", "keys", "ns"])

    return packed.repartition(parts, "part").mapInArrow(run, "bucket int, keys binary, ns binary")


def _rows(texts: pa.Table) -> Iterator[tuple]:
    for x in texts.to_batches():
        yield from zip(x.column("id").to_pylist(), x.column("th").to_pylist(), (b.as_py() for b in x.column("b")), strict=True)


def _copies(notes: pa.Table) -> set:
    """``(id, th)`` of rows that repeat the whole text of an earlier one: they need no search."""
    return {(i, th) for i, th, a, th_a in zip(*(notes.column(c).to_pylist() for c in ("id", "th", "a", "kind")), strict=True) if th_a == COPY and a > 0}


# Kinds of notes on a bucket: packed anchors, a copy of another row's text, a range to remove.
KEYS, COPY, RANGE = 0, 1, 2


def _stretches(docs: DataFrame, notes: DataFrame, law: Law, frequent: bool) -> DataFrame:
    """``(key, id, th, start, size, seg)``: runs of windows with an anchor that is at two places or more; ``seg`` holds their tokens."""
    def run(texts: pa.Table, own: pa.Table) -> pa.Table:
        later = _copies(own)
        blobs = [(k, n) for k, n, kind in zip(*(own.column(c).to_pylist() for c in ("keys", "ns", "kind")), strict=True) if kind == KEYS]
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k, np.uint64) for k, _ in blobs)])
        ns = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(n, np.uint16) for _, n in blobs)])
        known = np.sort(keys[(ns > FREQUENT) == frequent])
        out: dict[str, list] = {"key": [], "id": [], "th": [], "start": [], "size": [], "seg": []}
        for i, th, b in _rows(texts) if len(known) else ():
            if (i, th) in later:
                continue
            t = Tokens(law, b)
            start, size, key = anchors.runs(t.hashes, law.width, law.gram)
            spot = np.searchsorted(known, key)
            for k in np.flatnonzero(known[np.minimum(spot, len(known) - 1)] == key).tolist():
                a, n = int(start[k]), int(size[k])
                for c, v in zip(out, (int(key[k]), i, th, a, n, t.stretch(a, a + n + law.width - 1)), strict=True):
                    out[c].append(v)
        return pa.table({"key": pa.array(np.array(out["key"], dtype=np.uint64).view(np.int64)), "id": pa.array(out["id"], texts.schema.field("id").type), "th": pa.array(out["th"], pa.int64()),
                         "start": pa.array(out["start"], pa.int32()), "size": pa.array(out["size"], pa.int32()), "seg": pa.array(out["seg"], pa.binary())})

    return docs.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(run, f"key long, id {docs.schema['id'].dataType.simpleString()}, th long, start int, size int, seg binary")


def _nullable(t: pa.DataType) -> pa.DataType:
    """The type with fields that may be null, as the result's schema says."""
    if pa.types.is_struct(t):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(pa.field(t.value_field.name, _nullable(t.value_type)))
    return t


class Shard:
    """Rows of one index: distinct stretches, and each row's place as one number that sorts as (id, text, start)."""

    def __init__(self, t: pa.Table, law: Law):
        self.law = law
        pairs = list(zip(t.column("id").to_pylist(), t.column("th").to_pylist(), strict=True))
        code = {p: k for k, p in enumerate(sorted(set(pairs), key=lambda p: (p[0] is not None, 0 if p[0] is None else p[0], p[1])))}
        self.start, size = t.column("start").to_numpy().astype(np.int64), t.column("size").to_numpy().astype(np.int64)
        self.place = np.array([code[p] for p in pairs], dtype=np.int64) * (1 << 32) + self.start
        seen: dict[bytes, int] = {}
        self.of = np.array([seen.setdefault(s, len(seen)) for s in t.column("seg").to_pylist()], dtype=np.int64)
        self.segs = list(seen)
        self.size = np.zeros(len(seen), np.int64)
        self.size[self.of] = size
        self.first, self.last = np.full(len(seen), 1 << 62), np.full(len(seen), -1)
        np.minimum.at(self.first, self.of, self.place)
        np.maximum.at(self.last, self.of, self.place)


def _decided(law: Law, index: Callable[[Shard], list[np.ndarray]]):
    """Runs the index over whole anchors and gives the ranges to remove. ``index`` returns, per distinct stretch, its repeated windows' offsets."""
    def removed(t: pa.Table) -> pa.RecordBatch:
        s = Shard(t, law)
        hits = index(s)
        rows, a, b = [], [], []
        whole = s.place > s.first[s.of] if law.keep_first else (s.first != s.last)[s.of]
        for r, (d, start) in enumerate(zip(s.of.tolist(), s.start.tolist(), strict=True)):
            if whole[r]:
                rows.append(r)
                a.append(start)
                b.append(start + int(s.size[d]) + law.width - 1)
            elif len(h := hits[d]):
                cut = np.flatnonzero(np.diff(h) > 1)
                for p, q in zip([h[0], *h[cut + 1]], [*h[cut], h[-1]], strict=True):
                    rows.append(r)
                    a.append(start + int(p))
                    b.append(start + int(q) + law.width)
        at = pa.array(rows, pa.int64())
        take = lambda c: t.column(c).combine_chunks().take(at)
        return pa.RecordBatch.from_arrays([take("id"), take("th"), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, size = [], 0
        for x in batches:
            rest.append(x)
            size += x.column("seg").nbytes // (6 if law.words else 1)
            if size < INDEX_TOKENS:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last anchor may go on
            at = 0
            while at < cut:  # by whole anchors, an index at a time
                sizes = np.cumsum(pa.compute.binary_length(t.column("seg").combine_chunks().slice(at, cut - at)).to_numpy()) // (6 if law.words else 1)
                to = at + max(1, int(np.searchsorted(sizes, INDEX_TOKENS)))
                to = cut if to >= cut else max(int(np.searchsorted(key, key[to], "left")), int(np.searchsorted(key, key[at], "right")))
                yield removed(t.slice(at, min(to, cut) - at))
                at = min(to, cut)
            rest = t.slice(cut).to_batches()
            size = sum(b.column("seg").nbytes for b in rest) // (6 if law.words else 1)
        if rest and sum(len(b) for b in rest):
            yield removed(pa.Table.from_batches(rest))

    return run


def _frequent(rows: DataFrame, law: Law) -> DataFrame:
    """The same ranges for anchors at very many places: distinct stretches, then windows by digest, both combined before the shuffle."""
    from xxhash import xxh3_128_digest

    rows = rows.withColumn("sid", F.unhex(F.md5("seg")))
    place = F.struct("id", "th", "start")
    distinct = rows.groupBy("key", "sid").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("seg").alias("seg"), F.first("size").alias("size"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own, off, end, dig = [], [], [], []
            for i, (b, n) in enumerate(zip(x.column("seg").to_pylist(), x.column("size").to_pylist(), strict=True)):
                t, at = Tokens(law, b), {}
                for k in range(n):
                    d = xxh3_128_digest(t.stretch(k, k + law.width))
                    at[d] = (at[d][0] if d in at else k, k)
                own.extend([i] * len(at))
                dig.extend(at)
                off.extend(k for k, _ in at.values())
                end.extend(k for _, k in at.values())
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.column(c).take(at) for c in ("key", "sid", "first", "last")), pa.array(off, pa.int32()), pa.array(end, pa.int32()), pa.array(dig, pa.binary())], ["key", "sid", "first", "last", "off", "end", "digest"])

    kind = distinct.schema["first"].dataType.simpleString()
    windows = distinct.select("key", "sid", "first", "last", "seg", "size").mapInArrow(digests, f"key long, sid binary, first {kind}, last {kind}, off int, end int, digest binary")
    moved = lambda place, k: F.struct(F.col(f"{place}.id").alias("id"), F.col(f"{place}.th").alias("th"), (F.col(f"{place}.start") + F.col(k)).alias("start"))
    ends = windows.groupBy("digest").agg(F.min(F.struct(moved("first", "off").alias("here"), "key", "sid", "off")).alias("own"), F.max(moved("last", "end")).alias("hi"))
    # Each digest keeps one window at most: its first place, or its only one. All other windows of a stretch are repeats, so
    # the kept ones go to their stretches and windows meet nothing.
    kept = ends if law.keep_first else ends.where(~(F.col("own.here") < F.col("hi")))
    kept = kept.select("own.*").groupBy("key", "sid").agg(F.array_sort(F.collect_list("off")).alias("kept"))
    known = distinct.select("key", "sid", "first", "last").join(kept, ["key", "sid"], "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    met = rows.select("key", "sid", "id", "th", "start", "size").join(known, ["key", "sid"])
    whole = F.col("first") < F.struct("id", "th", "start") if law.keep_first else F.col("first") < F.col("last")
    span = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "kept"), F.concat("kept", F.array("size")), lambda p, q: span(F.col("start") + p + 1, F.col("start") + q - 1 + law.width))
    ranges = F.when(whole, F.array(span(F.col("start"), F.col("start") + F.col("size") + law.width - 1))).otherwise(F.filter(between, lambda r: r["b"] - r["a"] >= law.width))
    return met.select("id", "th", F.explode(ranges).alias("r")).select("id", "th", "r.a", "r.b")


def cut_repeats(docs: DataFrame, law: Law, index: Callable[[Shard], list[np.ndarray]], finish: Callable, columns: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row a text: ``id`` and what ``finish(Tokens, keep mask, text)`` returns for ``columns``; with ``carry`` also the whole row as ``row``.

    1. Texts go to buckets, once; a row whose whole text an earlier row has is settled by a digest of it.
    2. Every bucket gives its distinct anchors; an anchor at one place only cannot hold a repeat.
    3. The runs of windows under the other anchors go to shards by anchor, where ``index`` decides; anchors at very many
       places are merged window by window, so no anchor fills a task.
    4. Ranges to remove meet their text in its bucket; the text is cut by their union.

    A null text counts as empty. Rows with equal id and text are one document
    (each gets its row); equal ids with different texts are told apart by a hash
    of the text, and a null id sorts first. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    b = text_bytes(text_col)
    row_of = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    src = docs.select(F.col(id_col).alias("id"), b.alias("b"), *row_of).withColumn("th", F.xxhash64("b"))
    row_cols, row_type = (["row"], f", row {src.schema['row'].dataType.simpleString()}") if carry else ([], "")
    kind = src.schema["id"].dataType.simpleString()
    total = src.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    bucket = F.pmod(F.xxhash64("id", "th"), F.lit(parts)).cast("int").alias("bucket")
    # rows with the same text: one is searched
    row = F.struct("id", "th")
    slim = src.select("id", "th", F.unhex(F.md5("b")).alias("md5"))
    sets = reliable_checkpoint(slim.groupBy("md5").agg(F.min(row).alias("first"), F.max(row).alias("last")).where("first < last").select("md5", "first"))
    copies = slim.join(sets, "md5").select(bucket, "id", "th", (F.col("first") < row).cast("long").alias("a"))
    copies = reliable_checkpoint(copies.where("a > 0") if law.keep_first else copies)
    none = lambda t: F.lit(None).cast(t)
    note = lambda df, k, **c: df.select("bucket", F.lit(k).alias("kind"), *[c.get(n, none(t)).alias(n) for n, t in (("keys", "binary"), ("ns", "binary"), ("id", kind), ("th", "long"), ("a", "long"), ("b", "long"))])
    copied = note(copies, COPY, id=F.col("id"), th=F.col("th"), a=F.col("a"))
    texts = src.select(bucket, "id", "th", "b", *row_cols).repartition(parts, "bucket")
    shared = note(_shared(_anchors(texts, copied, law, parts), parts), KEYS, keys=F.col("keys"), ns=F.col("ns")).unionAll(copied)
    rare = _stretches(texts, shared, law, False).repartition(parts, "key").sortWithinPartitions("key")
    out = rare.mapInArrow(_decided(law, index), f"id {kind}, th long, a long, b long").unionAll(_frequent(_stretches(texts, shared, law, True), law))
    gone = note(out.withColumn("bucket", bucket), RANGE, id=F.col("id"), th=F.col("th"), a=F.col("a"), b=F.col("b")).unionAll(copied)
    fields = [tuple(c.split()) for c in columns.split(",")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def cut(texts: pa.Table, own: pa.Table) -> pa.Table:
        ranges: dict[tuple, list] = {}
        whole = set()
        for k, i, th, p, q in zip(*(own.column(c).to_pylist() for c in ("kind", "id", "th", "a", "b")), strict=True):
            if k == COPY:
                whole.add((i, th))
            else:
                ranges.setdefault((i, th), []).append((p, q))
        rows = []
        for i, th, b in _rows(texts):
            t = Tokens(law, b)
            n = len(t.hashes)
            edge = np.zeros(n + 1, np.int64)
            if (i, th) in whole and n >= law.width:
                edge[0] = 1
            for p, q in ranges.get((i, th), ()):
                edge[p] += 1
                edge[q] -= 1
            rows.append(finish(t, np.cumsum(edge)[:-1] == 0, b))
        made = {c: pa.array([r[k] for r in rows], types[t]) for k, (c, t) in enumerate(fields)}
        return pa.table({"id": texts.column("id"), **made, **{c: texts.column(c).cast(_nullable(texts.schema.field(c).type)) for c in row_cols}})

    return texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(cut, f"id {kind}, {columns}{row_type}")
