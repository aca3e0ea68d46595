"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots; the bytes of each slot are summed; a versioned
map assigns slots to shards and is edited, never rebuilt, when shards are rebalanced or
added.  Only the slot sums and the map (both ``n_slots`` entries, whatever the corpus) reach
the driver.

Edge cases: a null or empty text has no bytes and counts ``OVERHEAD``; its CRC-32 is 0.
Records of one id and one text are one record with copies: they share a slot and take
consecutive places.  An empty table gives an empty result.  Columns other than the id and
the text are never looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphframe.llm.common import cut, text_bytes

#: Bytes that a stored record has besides its text.
OVERHEAD = 16
N_SLOTS = 4096
#: Records that one task numbers at a time.
CELL_ROWS = 50_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot; ``version`` counts the edits."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(0, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, shard in enumerate(self.shard_of):
            out[shard] += slot_bytes[slot]
        return out

    def rebalanced(self, slot_bytes: list[int], moves: int = 20_000) -> SlotMap:
        """Edit the map until no single move or swap brings the fullest shard nearer to the mean.

        Overfull shards give up their smallest slots, which go to the emptiest shards,
        largest first; then the fullest and the emptiest shard trade slots.
        """
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        mean = sum(loads) / self.n_shards
        held: list[list[int]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shard_of):
            held[shard].append(slot)
        pool = []
        for shard, slots in enumerate(held):
            slots.sort(key=lambda s: (-slot_bytes[s], s))
            while loads[shard] > mean and len(slots) > 1:
                pool.append(slots.pop())
                loads[shard] -= slot_bytes[pool[-1]]
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in sorted(pool, key=lambda s: (-slot_bytes[s], s)):
            load, shard = heapq.heappop(heap)
            shard_of[slot], loads[shard] = shard, load + slot_bytes[slot]
            held[shard].append(slot)
            heapq.heappush(heap, (loads[shard], shard))
        for _ in range(moves):
            if not _trade(shard_of, held, loads, slot_bytes):
                break
        return SlotMap(self.version + 1, self.n_shards, tuple(shard_of))

    def grown(self, slot_bytes: list[int]) -> SlotMap:
        """One more shard: slots move into it only, from the fullest shards."""
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        mean, new, filled = sum(loads) / (self.n_shards + 1), self.n_shards, 0
        order = sorted(range(len(shard_of)), key=lambda s: (slot_bytes[s], s))
        for slot in order:
            if loads[shard_of[slot]] > mean and filled + slot_bytes[slot] <= mean:
                loads[shard_of[slot]] -= slot_bytes[slot]
                filled += slot_bytes[slot]
                shard_of[slot] = new
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as rows (version, slot, shard)."""
        rows = [(self.version, slot, shard) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "map_version int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Append this version under ``path``; versions already there stay."""
        self.frame(spark).coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")


def load_map(spark: SparkSession, path: str, version: int) -> SlotMap:
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
    shards = tuple(r["shard"] for r in rows)
    return SlotMap(version, max(shards) + 1, shards)


def _trade(shard_of: list[int], held: list[list[int]], loads: list[int], size: list[int]) -> bool:
    """One move or swap between the fullest and the emptiest shard, if any brings them nearer."""
    top = max(range(len(loads)), key=loads.__getitem__)
    low = min(range(len(loads)), key=loads.__getitem__)
    gap = loads[top] - loads[low]
    best = (gap, None, None)
    lows = [None, *held[low]]
    for a in held[top]:
        for b in lows:
            shift = size[a] - (size[b] if b is not None else 0)
            if 0 < shift < gap and abs(gap - 2 * shift) < best[0]:
                best = (abs(gap - 2 * shift), a, b)
    _, a, b = best
    if a is None:
        return False
    held[top].remove(a)
    held[low].append(a)
    shard_of[a] = low
    loads[top] -= size[a]
    loads[low] += size[a]
    if b is not None:
        held[low].remove(b)
        held[top].append(b)
        shard_of[b] = top
        loads[low] -= size[b]
        loads[top] += size[b]
    return True


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: a hash of its key, so it never depends on other records."""
    return F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(n_slots)).cast("int")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per slot of records (virtual_slot, size); ``n_slots`` numbers, whatever the corpus."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect()
    out = [0] * n_slots
    for r in sums:
        out[r["virtual_slot"]] = int(r["b"])
    return out


def place(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
    slot_map: SlotMap | None = None,
    map_path: str | None = None,
) -> tuple[DataFrame, SlotMap]:
    """Places of all records: (id, size, text_crc32, virtual_slot, shard, slot, map_version).

    ``slot`` numbers the records of a shard from 0 without gaps, in the order of virtual
    slots.  A cell (a part of a virtual slot) is numbered by one task and holds about
    ``CELL_ROWS`` records at any corpus size; offsets of cells come from their counts.
    """
    spark = docs.sparkSession
    n_cells = max(1, -(-docs.count() // (n_slots * CELL_ROWS)))
    records = docs.select(
        F.col(id_col).alias("__id"),
        text_bytes(F.col(text_col)).__add__(F.lit(OVERHEAD)).alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
    )
    records = (
        records.groupBy("__id", "size", "text_crc32")
        .agg(F.count("*").alias("__copies"))
        .withColumn("virtual_slot", virtual_slot(F.col("__id"), n_slots))
        .withColumn("__cell", F.pmod(F.xxhash64("__id", "text_crc32", "size"), F.lit(n_cells)).cast("int"))
    )
    records = cut(records)
    sums = slot_bytes(records.withColumn("size", F.col("size") * F.col("__copies")), n_slots)
    if slot_map is None:
        first = SlotMap.initial(n_slots, n_shards)
        slot_map = first.rebalanced(sums)
        if map_path:
            first.store(spark, map_path)
            slot_map.store(spark, map_path)
    if map_path:
        slot_map = load_map(spark, map_path, slot_map.version)
    shards = slot_map.frame(spark)
    cells = records.groupBy("virtual_slot", "__cell").agg(F.sum("__copies").alias("__n"))
    before = W.partitionBy("shard").orderBy("virtual_slot", "__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.join(F.broadcast(shards), "virtual_slot").select(
        "virtual_slot",
        "__cell",
        "shard",
        "map_version",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
    )
    within = (
        W.partitionBy("virtual_slot", "__cell")
        .orderBy("__id", "text_crc32", "size")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    numbered = (
        records.withColumn("__before", F.coalesce(F.sum("__copies").over(within), F.lit(0)))
        .join(cells, ["virtual_slot", "__cell"])
        .withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1)))
    )
    out = numbered.select(
        F.col("__id").alias(id_col),
        "size",
        "text_crc32",
        "virtual_slot",
        "shard",
        (F.col("__offset") + F.col("__before") + F.col("__copy")).cast("long").alias("slot"),
        "map_version",
    )
    return out, slot_map


def with_shard(
    docs: DataFrame,
    n_shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = N_SLOTS,
) -> DataFrame:
    """``docs`` with the columns shard, virtual_slot and map_version (in place of any of these names)."""
    size = text_bytes(F.col(text_col)) + F.lit(OVERHEAD)
    sums = slot_bytes(docs.select(virtual_slot(F.col(id_col), n_slots).alias("virtual_slot"), size.alias("size")), n_slots)
    slot_map = SlotMap.initial(n_slots, n_shards).rebalanced(sums)
    shards = slot_map.frame(docs.sparkSession)
    kept = docs.drop("virtual_slot", "shard", "map_version")
    return kept.withColumn("virtual_slot", virtual_slot(F.col(id_col), n_slots)).join(
        F.broadcast(shards), "virtual_slot"
    ).select(*kept.columns, "shard", "virtual_slot", "map_version")
