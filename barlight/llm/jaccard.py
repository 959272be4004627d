"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.llm.buckets import links_in_buckets, signature
from barlight.llm.common import text_bytes
from barlight.llm.components import components
from barlight.llm.simhash import _hashes
from barlight.session import reliable_checkpoint

# Shingles that a task packs at once, and about so many bytes of text to a range of hashes.
PACKED, RANGE_BYTES = 1 << 20, 24 << 20

_PACKED_ROWS = "kind int, slot long, stretch long, local int, id long, th long, same long, n long, keys binary, own binary"
_COUNTED = "kind int, stretch long, local int, id long, th long, same long, n long, at binary, met binary"


def _digest(words: list[bytes]) -> int:
    """64 bits that stand for a word sequence from here on."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(b" ".join(words), 7)).view(np.int64))


def _bytes_by_place(x: np.ndarray, most: int) -> bytes:
    """The ``most`` low bytes of whole numbers, all first bytes first: the high ones are nearly constant and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T[:most]).tobytes()


def _numbers(b: bytes, most: int, kind) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(most, -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :most] = planes.T
    return out.view(kind).ravel()


def _pack(shingle: int, ranges: int):
    """From documents ``id, th, b``: a row each (kind 0), and per stretch of them a row a range of hashes (1) and a row a text (2).

    A range's row has the upper 48 bits of the hashes, sorted, and which text of the stretch has each; -1 where two
    texts do. ``n`` of kind 2 counts a text's hashes of that sort, so a hash that all texts have travels once a stretch.
    """
    edges = np.array([k * 2**48 // ranges for k in range(1, ranges)], np.uint64)

    def rows(ids, ths, same, sizes, hashes) -> pa.RecordBatch:
        stretch = int.from_bytes(os.urandom(7), "little")
        texts, first = np.unique(np.array(same, np.int64), return_index=True)
        key = np.concatenate([hashes[k] for k in first]) >> np.uint64(16)
        own = np.repeat(np.arange(len(first), dtype=np.int32), [len(hashes[k]) for k in first])
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        shared = np.repeat(runs > 1, runs)
        known = np.bincount(own[shared], minlength=len(texts))
        own, key = np.where(shared, np.int32(-1), own)[new], key[new]
        cols = {c: [] for c in ("kind", "slot", "local", "id", "th", "same", "n", "keys", "own")}

        def add(kind, slot, local, i, th, s, n, k=None, o=None):
            for c, v in zip(cols, (kind, slot, local, i, th, s, n, k, o)):
                cols[c].append(v)

        for i, th, s, n in zip(ids, ths, same, sizes):
            add(0, stretch % ranges, None, i, th, s, n)
        for k, (s, n) in enumerate(zip(texts.tolist(), known.tolist())):
            add(2, stretch % ranges, k, None, None, s, n)
        bounds = [0, *np.searchsorted(key, edges).tolist(), len(key)]
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a < b:
                step = key[a:b].copy()
                step[1:] -= key[a:b - 1]
                add(1, r, None, None, None, None, None, _bytes_by_place(step, 6), _bytes_by_place(own[a:b], 4))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        out = {c: pa.array(v, t) for (c, v), t in zip(cols.items(), kinds)}
        out["stretch"] = pa.array([stretch] * len(cols["kind"]), pa.int64())
        names = [f.split()[0] for f in _PACKED_ROWS.split(", ")]
        return pa.RecordBatch.from_arrays([out[c] for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        for x in batches:
            for i, th, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2)):
                words = b.as_py().lower().split()
                h = np.unique(_hashes(words, shingle))
                for c, v in zip(held, (i, th, _digest(words), len(h), h)):
                    c.append(v)
                if sum(held[3][-64:]) >= PACKED or len(held[3]) % 64 == 0 and sum(held[3]) >= PACKED:
                    yield rows(*held)
                    held = [[], [], [], [], []]
        if held[0]:
            yield rows(*held)

    return run


def _count(t: pa.Table) -> pa.Table:
    """One range: a row a stretch with its texts whose hashes other texts have too, and how many. Documents and texts pass."""
    kind = t.column("kind").to_numpy()
    names = [f.split()[0] for f in _COUNTED.split(", ")]
    passed = t.filter(pa.array(kind != 1)).select(names[:-2])
    for name in names[-2:]:
        passed = passed.append_column(name, pa.nulls(passed.num_rows, pa.binary()))
    packed = t.filter(pa.array(kind == 1))
    keys = [np.cumsum(_numbers(b.as_py(), 6, np.uint64), dtype=np.uint64) for b in packed.column("keys")]
    if not keys:
        return passed
    own = np.concatenate([_numbers(b.as_py(), 4, np.int32) for b in packed.column("own")])
    row = np.repeat(np.arange(len(keys), dtype=np.int64), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, own, row = key[order], own[order], row[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    runs = np.diff(np.concatenate([starts, [len(key)]]))
    shared = np.repeat((runs > 1) | (np.minimum.reduceat(own, starts) < 0), runs) & (own >= 0)
    at, n = np.unique((row[shared] << 32) | own[shared].astype(np.int64), return_counts=True)
    bounds = np.searchsorted(at >> 32, np.arange(len(keys) + 1))
    part = lambda x: pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
    made = packed.select(["kind", "stretch", "local", "id", "th", "same", "n"]).append_column("at", part(at & 0xFFFFFFFF)).append_column("met", part(n))
    return pa.concat_tables([passed, made])


def _total(t: pa.Table) -> pa.Table:
    """One stretch: each text's digest and how many of its hashes other texts have."""
    kind = t.column("kind").to_numpy()
    texts, packed = t.filter(pa.array(kind == 2)).sort_by("local"), t.filter(pa.array(kind == 1))
    met = texts.column("n").to_numpy().copy()
    for at, n in zip(packed.column("at").to_pylist(), packed.column("met").to_pylist()):
        met[np.frombuffer(at, np.int32)] += np.frombuffer(n, np.int32)
    return pa.table({"same": texts.column("same"), "met": pa.array(met, pa.int64())})


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``(node, n, s)``: digest, number and hashes of the distinct shingles of rows ``id, th, b``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            words = [b.as_py().lower().split() for b in x.column("b")]
            sets = [np.unique(_hashes(w, shingle)).view(np.int64) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, words)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "s"])

    return docs.mapInArrow(run, "node long, n long, s array<long>")


def _prefix_entries(num: int, den: int):
    """Rows ``key, node, n, u, pos, sig`` of the prefixes of rows ``node, n, hs``.

    ``hs`` are the shared shingles from rare to frequent; the ``u`` others precede them and meet nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key, of, pos, sigs = [], [], [], []
            for k, (n, hs) in enumerate(zip(x.column("n").to_pylist(), x.column("hs"))):
                h = hs.values.to_numpy()
                sigs.append(signature(h))
                u = n - len(h)
                size = n + (-num * n // den) + 1 - u
                key.append(h[:max(0, size)])
                of += [k] * len(key[-1])
                pos.append(u + np.arange(len(key[-1])))
            at, n = pa.array(of, pa.int64()), x.column("n")
            u = pa.array([a - len(b) for a, b in zip(n.to_pylist(), x.column("hs"))], pa.int64())
            join = lambda p: np.concatenate([np.zeros(0, np.int64), *p])
            yield pa.RecordBatch.from_arrays([pa.array(join(key), pa.int64()), x.column("node").take(at), n.take(at), u.take(at), pa.array(join(pos), pa.int64()), pa.array(sigs, pa.binary()).take(at)], ["key", "node", "n", "u", "pos", "sig"])

    return run


def linked_texts(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(u, v)``: links that span all pairs of ``(node, n, s)`` with a Jaccard similarity of ``num / den`` or more.

    Shingles are ordered from rare to frequent; two such sets share one of their first
    ``n - ceil(n * num / den) + 1``. Those make the buckets of :func:`links_in_buckets`.
    """
    one = sets.select("node", "n", F.explode("s").alias("h"))
    df = reliable_checkpoint(one.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = one.join(df, "h").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    rows = reliable_checkpoint(shared.where(F.size("hs") * den >= F.col("n") * num).select("node", "n", F.col("hs.h").alias("hs")))
    entries = rows.mapInArrow(_prefix_entries(num, den), "key long, node long, n long, u long, pos long, sig binary")
    sizes = reliable_checkpoint(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    entries = reliable_checkpoint(entries.join(sizes, "key"))
    return links_in_buckets(rows, entries, num, den)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """``(id, th, n, component)`` per row: the number of distinct word shingles and the smallest id reachable over links of similarity ``num / den`` or more.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space; fewer
    words than a shingle make one shingle. Equal word sequences are one node, whatever
    their ids, and a repeated id with another text is another node. Texts without words
    (null and empty ones too) link nothing and are their own component. Rows with a null
    id have a null component and link nothing. ``th`` is a hash of the text. Whole texts
    are read; other columns are ignored; no rows give no rows.

    First a count of all shingles by packed hashes: a text goes on only if enough of its
    shingles occur elsewhere, which holds for all texts that link to a different one. Then
    :func:`linked_texts` over those, a row a different text. Texts are known by a 64-bit digest.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_bytes(text_col)).alias("th"), text_bytes(text_col).alias("b"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(parts, -(-total // RANGE_BYTES))
    counted = reliable_checkpoint(src.mapInArrow(_pack(shingle, ranges), _PACKED_ROWS).repartition(parts, "slot").groupBy("slot").applyInArrow(_count, _COUNTED))
    every = counted.where("kind = 0").select("id", "th", "same", "n")
    rep = every.where("id is not null and n > 0").groupBy("same").agg(F.min(F.struct("id", "th")).alias("r"), F.first("n").alias("n"))
    known = counted.where("kind > 0").groupBy("stretch").applyInArrow(_total, "same long, met long").groupBy("same").agg(F.max("met").alias("met"))
    going = reliable_checkpoint(rep.join(known, "same").where(F.col("met") * den >= F.col("n") * num).select(F.col("r.id").alias("i"), F.col("r.th").alias("t")).distinct())
    texts = src.join(going, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")), "left_semi")
    sets = reliable_checkpoint(_sets(texts, shingle).dropDuplicates(["node"]))
    comp = reliable_checkpoint(components(linked_texts(sets, num, den))).toDF("same", "label")
    labelled = every.join(comp, "same", "left").withColumn("label", F.coalesce("label", "same"))
    able = F.col("id").isNotNull() & (F.col("n") > 0)
    least = labelled.where(able).groupBy("label").agg(F.min("id").alias("least"))
    out = labelled.join(least, "label", "left")
    return out.select("id", "th", "n", F.when(able, F.col("least")).otherwise(F.col("id")).alias("component"))
