"""Shards by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm.common import text_bytes

# Fixed number of virtual slots; a property of the data set, never changed when shards are added.
SLOTS = 8_192


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(id, size, crc, virtual_slot)``: bytes of the text plus 8, its CRC-32, the slot of the id.

    A null text has no bytes. Rows with a null id go by a hash of the text, so
    that many of them do not meet in one slot.
    """
    b = text_bytes(text_col)
    at = F.coalesce(F.xxhash64(F.col(id_col).cast("string")), F.lit(0))
    at = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), b)).otherwise(at)
    return docs.select(F.col(id_col).alias("id"), (F.octet_length(b) + 8).cast("long").alias("size"), F.crc32(b).alias("crc"),
                       F.pmod(at, F.lit(slots)).cast("int").alias("virtual_slot"))


@dataclass
class SlotMap:
    """One version of the map: shard of each slot that holds rows, with the slot's bytes and rows. At most ``slots`` entries."""

    version: int
    shards: int
    shard: dict[int, int]
    size: dict[int, int]
    rows: dict[int, int]

    def frame(self, spark: SparkSession) -> DataFrame:
        first, here = [], dict.fromkeys(range(self.shards), 0)
        for v in sorted(self.shard):
            s = self.shard[v]
            first.append((self.version, v, s, self.size[v], self.rows[v], here[s]))
            here[s] += self.rows[v]
        return spark.createDataFrame(first, "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, first_place long")

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for v, s in self.shard.items():
            out[s] += self.size[v]
        return out


def first_map(rows: DataFrame, shards: int) -> SlotMap:
    """Version 1: bytes per slot, then the heaviest slot first to the lightest shard."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()  # at most one row a slot
    size, n = {r[0]: r[1] for r in found}, {r[0]: r[2] for r in found}
    heap, shard = [(0, s) for s in range(shards)], {}
    for v in sorted(size, key=lambda v: (-size[v], v)):
        load, s = heapq.heappop(heap)
        shard[v] = s
        heapq.heappush(heap, (load + size[v], s))
    return SlotMap(1, shards, shard, size, n)


def grown_map(old: SlotMap) -> SlotMap:
    """The next version, with one more shard: slots move to it alone, from the heaviest shard each time, until it has its share."""
    new, shard, load = old.shards, dict(old.shard), [*old.loads(), 0]
    share = sum(load) / (old.shards + 1)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(old.shards)}
    for v, s in old.shard.items():
        held[s].append((old.size[v], v))
    for s in held:
        held[s].sort()
    while any(held.values()):
        s = max((s for s in held if held[s]), key=lambda s: (load[s], -s))
        size, v = held[s].pop()
        if load[new] + size > share:
            continue  # too large for what is missing; smaller ones follow
        shard[v] = new
        load[s] -= size
        load[new] += size
    return SlotMap(old.version + 1, old.shards + 1, shard, old.size, old.rows)


def store_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Write one version; versions are never overwritten."""
    slot_map.frame(spark).coalesce(1).write.mode("error").parquet(f"{folder}/version={slot_map.version:06d}")


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    found = spark.read.parquet(f"{folder}/version={version:06d}").collect()
    return SlotMap(version, 1 + max((r.shard for r in found), default=0), {r.virtual_slot: r.shard for r in found},
                   {r.virtual_slot: r.slot_bytes for r in found}, {r.virtual_slot: r.slot_rows for r in found})


def placed(spark: SparkSession, rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """``rows`` with ``shard`` and ``place``, gapless from 0 in each shard.

    The place is the number of rows in the shard's earlier slots, which the map
    knows, plus the place inside the slot; only rows of one slot are ordered
    together, never a whole shard. The map has at most ``slots`` rows, so it is
    broadcast. Repeated rows get a place each; an empty table gives no rows.
    """
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc", "size")) - 1
    at = slot_map.frame(spark).select("virtual_slot", "shard", "first_place")
    return rows.withColumn("inside", inside).join(F.broadcast(at), "virtual_slot").withColumn("place", F.col("first_place") + F.col("inside")).drop("first_place", "inside")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int, folder: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Rows with shard and place under version 1 of the map, and the shard under version 2 with one shard more; both versions are stored."""
    rows = slotted(docs, id_col, text_col, slots)
    one = first_map(rows, shards)
    two = grown_map(one)
    for m in (one, two):
        store_map(spark, m, folder)
    later = two.frame(spark).select("virtual_slot", F.col("shard").alias("next_shard"))
    return placed(spark, rows, one).join(F.broadcast(later), "virtual_slot")
