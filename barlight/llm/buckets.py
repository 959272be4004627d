"""Pairs inside buckets: what may be similar is compared, what is linked already is not."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.components import components
from barlight.session import reliable_checkpoint

# Buckets up to this size are compared pair by pair at once; members of larger ones meet so many leaders in each of so many rounds first.
CLOSE, LEADERS, ROUNDS = 8, 4, 2
# Members of one bucket that meet in one task; larger buckets are dealt out in blocks.
BLOCK = 1_024
# Words of 64 bits in a suffix signature.
CELLS = 16


def signature(h: np.ndarray) -> bytes:
    """Bit c is set if an odd number of the hashes fall into cell c: two sets differ in as many elements at least as their signatures in bits."""
    cells = np.bincount((h.view(np.uint64) % np.uint64(64 * CELLS)).astype(np.int64), minlength=64 * CELLS) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def by_key(names: list[str], links):
    """``links`` over batches of rows sorted by key, each key whole in one call."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for x in batches:
            t = pa.Table.from_batches([x]).select(names)
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last key may go on
            if cut:
                yield links(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield links(rest)

    return run


def _bucket_pairs(num: int, den: int):
    """Rows sorted by key, each key whole: the pairs of different components that length, positions and signatures allow."""
    names = ["key", "node", "n", "u", "pos", "sig", "comp", "blk", "mixed"]

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, node, n, u, pos, comp, blk, mixed = (t.column(c).to_numpy() for c in names if c != "sig")
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, CELLS)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = np.arange(len(key)), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            a, b = at, at + step
            fits = (comp[a] != comp[b]) & ((mixed[a] == 0) | (blk[a] != blk[b])) & (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b]))
            a, b = a[fits], b[fits]
            least = -(-num * (n[a] + n[b]) // (num + den))
            fits = 1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= least
            a, b, least = a[fits], b[fits], least[fits]
            for k in range(0, len(a), 1 << 16):
                i, j = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
                apart = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1, dtype=np.int64)
                close = apart <= n[i] + n[j] - 2 * least[k:k + (1 << 16)] - u[i] - u[j]
                out_a.append(np.minimum(node[i[close]], node[j[close]]))
                out_b.append(np.maximum(node[i[close]], node[j[close]]))
            step += 1
        a, b = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return names, by_key(names, pairs)


def _signed_pairs(num: int, den: int):
    """Rows of two sets, their sizes, lone elements and signatures: the pairs that signatures allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, n, m, lone = (x.column(k).to_numpy() for k in range(5))
            one, two = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint64).reshape(-1, CELLS) for k in (5, 6))
            least = -(-num * (n + m) // (num + den))
            close = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= n + m - 2 * least - lone
            a, b = np.unique(np.stack([np.minimum(a, b)[close], np.maximum(a, b)[close]], 1), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    return run


def _least_overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """The smallest overlap of sets of these sizes at the similarity."""
    return F.ceil(F.lit(num) * (n + m) / F.lit(num + den)).cast("long")


def links_in_buckets(rows: DataFrame, entries: DataFrame, num: int, den: int, pairs: DataFrame | None = None) -> DataFrame:
    """``(u, v)``: links that span all pairs of one bucket with a Jaccard similarity of ``num / den`` or more.

    ``rows`` are ``(node, n, hs)``: a set's size and those of its hashes that other sets may have. ``entries`` are
    ``(key, members, node, n, u, pos, sig)``: the sets of each bucket, with the bucket's size, how many of
    the set's elements no other set has, the place of the key in the set's order (0 where there is none) and the
    :func:`signature` of ``hs``. A pair is looked at if lengths, places and signatures allow the similarity, and then
    verified by its hashes, once. Large buckets go in rounds: members meet a few leaders, what links is contracted, and
    only members of different components are compared further, in blocks. No pair that could join two components is left out.
    ``pairs`` ``(u, v)`` are candidates from elsewhere: they are verified and contracted before large buckets are looked at,
    and then each set meets leaders of its largest bucket only, before all of its buckets go in rounds.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, in_buckets = _bucket_pairs(num, den)

    def compared(members: DataFrame) -> DataFrame:
        return members.repartition(parts, "key").sortWithinPartitions("key").select(*names).mapInArrow(in_buckets, "u long, v long")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among the pairs that were not tried before."""
        nonlocal tried
        fresh = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["u", "v"], "left_anti")
        fresh = reliable_checkpoint(fresh)
        tried = fresh if tried is None else tried.unionAll(fresh)
        side = lambda c: rows.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("hs").alias(f"h{c}"))
        both = fresh.join(side("u"), "u").join(side("v"), "v")
        return reliable_checkpoint(both.where(F.size(F.array_intersect("hu", "hv")) * (num + den) >= num * (F.col("nu") + F.col("nv"))).select("u", "v"))

    tried: DataFrame | None = None
    alone = entries.withColumns({"comp": F.col("node"), "blk": F.lit(0).cast("long"), "mixed": F.lit(0).cast("long")})
    near = compared(alone.where(F.col("members") <= CLOSE))
    links = verified(near if pairs is None else near.unionAll(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))))
    hot = entries.where(F.col("members") > CLOSE)
    if hot.isEmpty():
        return links

    def placed(members: DataFrame) -> DataFrame:
        """With the component that the links so far put each member in."""
        comp = components(links).toDF("node", "comp")
        return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def grouped() -> DataFrame:
        """Members of large buckets that still hold more than one component."""
        now = placed(hot)
        several = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key")
        return reliable_checkpoint(now.join(several, "key", "left_semi"))

    def with_leaders(now: DataFrame, turn: int) -> DataFrame:
        """The links of members to the leaders of their buckets."""
        member = F.struct("node", "n", "pos", "comp", "u", "sig")
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn * LEADERS + k)).alias("h"), member.alias("m"))).alias(f"l{k}") for k in range(LEADERS)]
        leads = now.groupBy("key").agg(*drawn).select("key", F.explode(F.array_distinct(F.array(*[f"l{k}.m" for k in range(LEADERS)]))).alias("lead"))
        least = _least_overlap(F.col("n"), F.col("lead.n"), num, den)
        fits = (F.col("comp") != F.col("lead.comp")) & (F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num) & (F.least(F.col("n") - F.col("pos"), F.col("lead.n") - F.col("lead.pos")) >= least)
        met = now.withColumnRenamed("key", "k").join(reliable_checkpoint(leads), (F.col("k") == F.col("key")) & fits)
        both = met.select("node", F.col("lead.node"), "n", F.col("lead.n"), F.col("u") + F.col("lead.u"), "sig", F.col("lead.sig")).toDF("a", "b", "n", "m", "lone", "one", "two")
        return verified(both.mapInArrow(_signed_pairs(num, den), "u long, v long"))

    if pairs is None:
        now = reliable_checkpoint(hot.withColumn("comp", F.col("node")))
    else:
        largest = hot.groupBy("node").agg(F.max(F.struct("members", "key"))["key"].alias("key"))
        home = reliable_checkpoint(hot.join(largest, ["node", "key"]))
        for turn in range(ROUNDS):  # a row a set: its other buckets wait, they are not passed on from round to round
            links = links.unionAll(with_leaders(reliable_checkpoint(placed(home)), -1 - turn))
        now = grouped()
    for turn in range(ROUNDS):
        links = links.unionAll(with_leaders(now, turn))
        now = grouped()
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    dealt = now.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumns({"key": F.when(blocks == 1, F.col("key")).otherwise(F.xxhash64("key", low, high)), "blk": F.col("own"), "mixed": (low != high).cast("long")})
    return links.unionAll(verified(compared(dealt)))
