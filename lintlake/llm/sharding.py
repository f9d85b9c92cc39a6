"""Sharding by fixed virtual slots.

Every record hashes into one of a few thousand virtual slots, for good.  Bytes are summed per
slot, and a versioned slot-to-shard map (a small table in the shared folder) says where each
slot lives.  Rebalancing writes a new version, in which as few slots as possible have moved.
Only DataFrame operations touch the records.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, text_bytes, written

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot).  A null text is empty; rows without a doc_id are spread over all slots one by one."""
    unknown = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return docs.select(
        "doc_id",
        (text_bytes() + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", F.col("text"), unknown), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: contiguous runs of slots, as even as can be."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(slot_to_shard: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    """Edits a map until no single move or swap out of the fullest shard evens the bytes any more.

    Works on one number per slot, never on records.  Shards beyond those in the map start empty, so
    growing a cluster is the same edit.
    """
    where, load = list(slot_to_shard), [0] * shards
    owned: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(where):
        load[shard] += slot_bytes[slot]
        owned[shard].add(slot)

    def put(slot: int, to: int) -> None:
        load[where[slot]] -= slot_bytes[slot]
        owned[where[slot]].discard(slot)
        where[slot] = to
        load[to] += slot_bytes[slot]
        owned[to].add(slot)

    mean = sum(load) / shards
    loose: list[tuple[int, int]] = []
    for shard in range(shards):  # what stands above the mean comes loose, the smaller slots last
        for slot in sorted(owned[shard], key=lambda s: (-slot_bytes[s], s)):
            if load[shard] - slot_bytes[slot] >= mean and slot_bytes[slot]:
                load[shard] -= slot_bytes[slot]
                owned[shard].discard(slot)
                loose.append((-slot_bytes[slot], slot))
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for size, slot in sorted(loose):  # the largest first, each into the emptiest shard
        _, to = heapq.heappop(heap)
        where[slot] = to
        load[to] -= size
        owned[to].add(slot)
        heapq.heappush(heap, (load[to], to))
    for _ in range(8 * shards):  # then single moves and swaps between the fullest and the emptiest
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        best = min(((abs(gap - 2 * (slot_bytes[a] - b)), a, c) for a in owned[full] for b, c in [(0, -1), *((slot_bytes[x], x) for x in owned[empty])]), default=(gap, -1, -1))
        if best[0] >= gap:
            break
        put(best[1], empty)
        if best[2] >= 0:
            put(best[2], full)
    return where


class SlotMap:
    """The versions of a slot-to-shard map under one folder, a small Parquet table each."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"

    def write(self, version: int, slot_to_shard: list[int]) -> None:
        rows = [(version, slot, shard) for slot, shard in enumerate(slot_to_shard)]
        self.spark.createDataFrame(rows, "version int, virtual_slot int, shard int").coalesce(1).write.parquet(f"{self.folder}/version={version}")

    def latest(self) -> int:
        """The highest version there is; 0 without any."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return 0
        return self.spark.read.schema("virtual_slot int, shard int, version int").parquet(self.folder).agg(F.max("version")).first()[0] or 0

    def shards(self, version: int) -> list[int]:
        """The shard of every slot, by slot; a map that misses or repeats a slot is an error."""
        rows = sorted(self.read(version).collect())  # one row a slot
        if [r.virtual_slot for r in rows] != list(range(len(rows))):
            raise ValueError(f"version {version} of the slot map in {self.folder} does not hold every slot once")
        return [r.shard for r in rows]

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.folder}/version={version}").select("virtual_slot", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = 40, slots: int = SLOTS, maps: SlotMap | None = None) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, virtual_slot, shard, slot (its place in the shard, from 0), map_version.

    ``maps``: the latest version there is loaded and edited, and the edit is the next version; without any
    version (as in a new folder, the default) even runs of ``slots`` slots are the first.  A map that is there says itself how many
    slots there are, for good, so that no record hashes into a slot it does not know.  The shards' bytes come out as near
    equal as whole slots allow.  Null and empty texts weigh 16 bytes; equal texts are placed by their own
    doc_id, so a large group of copies spreads over all slots, and so do rows that have no doc_id or repeat one
    with other texts; rows that repeat as a whole share a slot and get places of their own.  An empty table gives no
    rows.  Extra columns of ``docs`` are ignored.
    """
    maps = maps or SlotMap(docs.sparkSession)
    version = maps.latest()
    before = maps.shards(version) if version else first_map(shards, slots)
    slots = len(before)
    if not version:
        maps.write(version := 1, before)
    kept = written(records(docs, slots), "records")
    sums = dict.fromkeys(range(slots), 0) | {r.virtual_slot: r.b for r in kept.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()}  # one number a slot
    after = rebalanced([min(s, shards - 1) for s in before], [sums[s] for s in range(slots)], shards)
    if after != before:
        maps.write(version := version + 1, after)
    counts = kept.groupBy("virtual_slot").agg(F.count("*").alias("n"))
    placed = counts.join(F.broadcast(maps.read(version)), "virtual_slot")
    starts = placed.select("virtual_slot", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return kept.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(version).alias("map_version"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
