"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, one of a fixed number of slots whatever the shards. The bytes of each slot
are summed, and a map says which shard a slot belongs to. The map is versioned: rebalancing edits a copy,
moving as few slots as evenness needs, and older versions stay readable. A table that was sharded before is sharded
again by its stored map: this is read, edited for the bytes and shards of now, and stored as one more version.

Equal texts with unlike ids may part: the law is `bytes`, and one text may hold a third of all bytes.

Defined results: a null text has no bytes of its own; rows with a null id go by their text; repeated rows have a place each,
ordered by id and text; an empty table gives no rows; further columns are ignored by `assign`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slots; fixed for the life of a data set.
SLOTS = 8192


@dataclass
class SlotMap:
    """shard_of[version][slot]; weights has the bytes of each slot when the last version was made."""

    shards: int
    versions: list[list[int]] = field(default_factory=list)

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def loads(self, weights: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.current):
            out[shard] += weights[slot]
        return out

    def rebalance(self, weights: list[int], shards: int | None = None) -> SlotMap:
        """A new version, made by edits of the last: slots of shards above the mean move to the least loaded one, the
        largest that fits first, for as long as a move brings the two closer. Slots of shards that are no more are dealt to the least loaded first."""
        self.shards = shards or self.shards
        shard_of = list(self.current)
        gone = sorted((s for s, shard in enumerate(shard_of) if shard >= self.shards), key=lambda s: (-weights[s], s))
        kept = [sum(weights[s] for s, x in enumerate(shard_of) if x == shard) for shard in range(self.shards)]
        for s in gone:
            shard_of[s] = min(range(self.shards), key=lambda x: (kept[x], x))
            kept[shard_of[s]] += weights[s]
        loads = [0] * self.shards
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            loads[shard] += weights[slot]
            own[shard].append(slot)
        for _ in range(4 * len(shard_of)):  # each move lowers the sum of squared loads; this many are never needed
            high = max(range(self.shards), key=lambda s: (loads[s], -s))
            low = min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[high] - loads[low]
            move = max((s for s in own[high] if 0 < weights[s] <= gap // 2), key=lambda s: (weights[s], -s), default=None)
            if move is None:
                break
            own[high].remove(move)
            own[low].append(move)
            shard_of[move] = low
            loads[high] -= weights[move]
            loads[low] += weights[move]
        self.versions.append(shard_of)
        return self

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, virtual_slot, shard) of all versions."""
        return spark.createDataFrame([(v, s, x) for v, m in enumerate(self.versions) for s, x in enumerate(m)], "version int, virtual_slot int, shard int")


def new_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0: slots dealt out in turn."""
    return SlotMap(shards, [[s % shards for s in range(slots)]])


def save_map(slot_map: SlotMap, spark: SparkSession, path: str) -> None:
    """Adds the versions that the stored map doesn't have; stored ones are never rewritten."""
    for v in range(len(slot_map.versions)):
        rows = [(s, x) for s, x in enumerate(slot_map.versions[v])]
        spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("ignore").parquet(f"{path}/version={v}")


def load_map(spark: SparkSession, path: str) -> SlotMap:
    """The stored map with all its versions; as many slots and shards as the last version has."""
    rows = spark.read.parquet(path).collect()  # slots times versions
    slots = 1 + max(r["virtual_slot"] for r in rows)
    versions = [[0] * slots for _ in range(1 + max(r["version"] for r in rows))]
    for r in rows:
        versions[r["version"]][r["virtual_slot"]] = r["shard"]
    return SlotMap(1 + max(versions[-1]), versions)


def has_map(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    slot = F.pmod(own, F.lit(slots)).cast("int")
    return docs.select(id_col, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot.alias("virtual_slot"))


def slot_bytes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Rows with shard and slot: the place within the shard, from 0 without gaps.

    map_path: where the map is stored. If one is there, it is edited, and its number of slots holds; the result goes by the version that this adds.
    Only a row for each virtual slot, of which there is a fixed number, reaches the driver. Places are numbered
    within virtual slots, then moved on by the rows of the slots before, so that no task holds a whole shard.
    """
    spark = docs.sparkSession
    stored = load_map(spark, map_path) if map_path and has_map(spark, map_path) else None
    slots = len(stored.current) if stored else slots
    slotted = with_slots(docs, id_col, text_col, slots)
    weights, rows = [0] * slots, [0] * slots
    for r in slot_bytes(slotted).collect():
        weights[r["virtual_slot"]], rows[r["virtual_slot"]] = r["bytes"], r["rows"]
    slot_map = (stored or new_map(shards, slots)).rebalance(weights, shards)
    if map_path:
        save_map(slot_map, spark, map_path)
    before, table = [0] * shards, []
    for s, shard in enumerate(slot_map.current):
        table.append((s, shard, before[shard]))
        before[shard] += rows[s]
    places = spark.createDataFrame(table, "virtual_slot int, shard int, before long")
    at = F.row_number().over(W.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")) - 1
    return slotted.withColumn("at", at).join(F.broadcast(places), "virtual_slot").withColumn("slot", (F.col("before") + F.col("at")).cast("long")).drop("at", "before")
