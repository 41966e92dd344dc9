"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots that never changes; a small, versioned map says which shard holds a
slot. Moving data between shards means editing the map: slots move, records keep their slot. The map has one row per
slot, so its size is a parameter and not a function of the data; it may be collected and broadcast.

Nulls: a null text counts no bytes and has checksum 0. A null id is hashed by the checksum of its text. Repeated rows
share a slot. An empty table gives an empty result and a map that spreads the slots evenly. Very long texts count their bytes like
any other. Other columns may have any name: only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage_path, text_of

SLOTS = 4096
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of each record."""
    crc = F.crc32(text_of())
    return docs.select(
        "doc_id",
        (F.octet_length(text_of()) + OVERHEAD).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), crc.cast("string"))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


@dataclass
class SlotMap:
    """The slot-to-shard map as a log of edits: version 0 sets every slot, later versions only the slots that moved."""

    slots: int
    shards: int
    edits: list[tuple[int, int, int]] = field(default_factory=list)

    @classmethod
    def even(cls, slots: int, shards: int) -> SlotMap:
        return cls(slots, shards, [(0, s, s % shards) for s in range(slots)])

    @property
    def version(self) -> int:
        return max((v for v, _, _ in self.edits), default=-1)

    def at(self, version: int | None = None) -> list[int]:
        """Shard of each slot as of a version (the latest by default)."""
        now = [0] * self.slots
        for v, slot, shard in sorted(self.edits):
            if version is None or v <= version:
                now[slot] = shard
        return now

    def rebalanced(self, sizes: dict[int, int], shards: int | None = None) -> SlotMap:
        """A new version: slots move from the fullest shard to the emptiest while that narrows the gap between them."""
        shards = shards or self.shards
        before = self.at()
        now = [s if s < shards else s % shards for s in before]
        held: list[set[int]] = [set() for _ in range(shards)]
        load = [0] * shards
        for slot, shard in enumerate(now):
            held[shard].add(slot)
            load[shard] += sizes.get(slot, 0)
        full = [(-x, i) for i, x in enumerate(load)]
        empty = [(x, i) for i, x in enumerate(load)]
        heapq.heapify(full)
        heapq.heapify(empty)
        for _ in range(20 * self.slots):
            while -full[0][0] != load[full[0][1]]:
                heapq.heappop(full)
            while empty[0][0] != load[empty[0][1]]:
                heapq.heappop(empty)
            high, low = full[0][1], empty[0][1]
            gap = load[high] - load[low]
            slot = min((s for s in held[high] if 0 < sizes.get(s, 0) < gap), key=lambda s: (abs(2 * sizes[s] - gap), s), default=None)
            if slot is None:
                break
            held[high].remove(slot)
            held[low].add(slot)
            now[slot] = low
            for shard, by in ((high, -sizes[slot]), (low, sizes[slot])):
                load[shard] += by
                heapq.heappush(full, (-load[shard], shard))
                heapq.heappush(empty, (load[shard], shard))
        moved = [(self.version + 1, s, now[s]) for s in range(self.slots) if now[s] != before[s]]
        return SlotMap(self.slots, shards, self.edits + moved)

    def save(self, spark: SparkSession, path: str, since: int = -1) -> None:
        """Append the versions behind ``since`` to the stored map."""
        new = [e for e in self.edits if e[0] > since]
        if new:
            spark.createDataFrame(new, "version int, slot int, shard int").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def is_stored(spark: SparkSession, path: str) -> bool:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    @classmethod
    def load(cls, spark: SparkSession, path: str, slots: int, shards: int) -> SlotMap:
        rows = spark.read.parquet(path).collect()
        return cls(slots, shards, sorted((r.version, r.slot, r.shard) for r in rows))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its virtual slot, its shard, and its gapless position in the shard.

    A map stored at ``path`` is loaded, rebalanced for these records (and for another number of shards), and what moved is
    appended as one version; without one, slots start evenly. Only totals per slot reach the driver. Positions come from a row number within each slot plus the number of rows in
    the shard's earlier slots, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    records = sized(docs, slots)
    totals = slot_totals(records).collect()
    path = path or stage_path(spark, "slot-map")
    stored = SlotMap.load(spark, path, slots, shards) if SlotMap.is_stored(spark, path) else None
    slot_map = (stored or SlotMap.even(slots, shards)).rebalanced({r.virtual_slot: r.bytes for r in totals}, shards)
    slot_map.save(spark, path, stored.version if stored else -1)
    counts = {r.virtual_slot: r.rows for r in totals}
    before, base = [0] * shards, []
    for slot, to in enumerate(slot_map.at()):
        base.append((slot, to, before[to]))
        before[to] += counts.get(slot, 0)
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("at", F.row_number().over(within) - 1)
        .join(F.broadcast(places), "virtual_slot")  # one row per slot
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot"), "virtual_slot",
                F.lit(slot_map.version).alias("map_version"))
    )
